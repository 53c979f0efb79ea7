"""Personal data by candidate gradient boosting, in DataFrame functions only.

Fixed forms (e-mail, IP address, card, phone) are found as they are. Besides, generators of high recall propose spans that
may overlap; a candidate's format and context are made features, boosted trees score them as one SQL expression, and a
threshold calibrated for each generator decides. The trees are fitted on labelled examples that this module makes by rule.

The patterns are written with possessive loops and start where a run starts, so that long runs cost linear time and no stack.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, texts

KINDS = ("email", "ip", "card", "phone")
_SPAN = "start:int,end:int,hit:string,before:string,after:string"
SPANS = f"array<struct<{_SPAN}>>"
#: Items of a block of ``running``.
BLOCK = 128
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Generators: name, what a text must hold to be searched, pattern. The name is the kind of the spans that they add.
GENERATORS = (
    ("number", "[0-9]", r"(?<![0-9A-Za-z.,+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])"),
    ("address", r"(?i)[\[({ ]at[\])} ]", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++ ?[\[({ ]at[\])} ] ?[a-z0-9-]++(?: ?(?:\.|[\[({ ]dot[\])} ]) ?[a-z0-9-]++)++"),
    ("account", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"),
    ("date", "[0-9][./-][0-9]", r"(?<![0-9A-Za-z./-])[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{2,4}(?![0-9A-Za-z/-])"),
    ("device", "[0-9A-Fa-f][:-][0-9A-Fa-f]", r"(?<![0-9A-Za-z:-])(?:[0-9A-Fa-f]{1,4}[:-]){5,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:-])"),
)
CONTEXT = 28
_WORDS = r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|mail|e-mail|email|contact|write|reach|ssn|social security|iban|account|acct|passport|card)\b"
_BORN = r"(?i)\b(?:born|birth|birthday|birthdate|dob)\b"
_MAC = r"(?i)\b(?:mac|ipv6|device|adapter|interface|host|inet6)\b"
_UNIT = r"(?i)^\x20?(?:units?|items?|pieces|pcs|kg|km|ms|usd|eur|dollars|euros|percent|%|times|rows|bytes|tokens|copies|points)"


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """The running results of an associative ``combine`` of whole numbers, such as sums or maxima.

    An aggregate copies its state for every item, so that one over a whole long array takes the square of its length. Blocks are
    gone through each on its own, and what the blocks before come to is combined with each.
    """
    none, start = F.array().cast("array<int>"), F.lit(zero).cast("int")
    count = F.ceil(F.size(values) / BLOCK).cast("int")
    blocks = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))

    def scan(items: Column, value: Callable[[Column], Column], after: bool) -> Column:
        def add(s: Column, x: Column) -> Column:
            now = combine(s["at"], value(x)).cast("int")
            return F.struct(now.alias("at"), F.concat(s["out"], F.array(now if after else s["at"])).alias("out"))

        return F.aggregate(items, F.struct(start.alias("at"), none.alias("out")), add, lambda s: s["out"])

    scans = F.transform(blocks, lambda b: scan(b, lambda x: x, True))
    joined = lambda own: F.flatten(F.zip_with(own, scan(own, lambda b: F.element_at(b, -1), False), lambda b, o: F.transform(b, lambda x: combine(o, x).cast("int"))))
    return F.get(F.transform(F.array(scans), joined), F.lit(0))


def find(text: Column, pattern: str) -> Column:
    """(start, end, hit, before, after) of every match, places in code points.

    Matches and the gaps between them come from two passes of the same pattern; a running sum of their lengths gives places.
    The context is what the gaps hold on either side, up to CONTEXT characters: no text is cut by place, which would count
    its characters from the start for every match.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    parts = F.filter(parts, lambda x: x["hit"].isNotNull())

    def spans(x: Column) -> Column:
        ends = running(F.transform(x, lambda p: F.char_length(p["gap"]) + F.char_length(p["hit"])), lambda a, b: a + b, 0)
        return F.zip_with(x, ends, lambda p, e: F.struct((e - F.char_length(p["hit"])).alias("start"), e.alias("end"), p["hit"].alias("hit"), F.right(p["gap"], F.lit(CONTEXT)).alias("before"), F.left(p["next"], F.lit(CONTEXT)).alias("after")))

    return F.get(F.transform(F.array(parts), spans), F.lit(0))


def only_if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(SPANS))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((s["sum"] + F.when(s["odd"], d).otherwise(twice)).alias("sum"), (~s["odd"]).alias("odd"))

    chars = F.reverse(F.filter(F.split(number, ""), lambda c: c != ""))
    return F.aggregate(chars, F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), add, lambda s: s["sum"] % 10 == 0)


def base_columns(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    many = lambda hit, a, b: F.char_length(digits(hit)).between(a, b)
    return {
        "email": only_if(text.contains("@"), find(text, EMAIL)),
        "ip": only_if(text.rlike(r"[0-9]\.[0-9]"), F.filter(find(text, IP), lambda s: s["hit"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))),
        "card": only_if(digit, F.filter(find(text, CARD), lambda s: luhn(digits(s["hit"])))),
        "phone": only_if(text.contains("+"), F.filter(find(text, PHONE), lambda s: many(s["hit"], 9, 15))),
    }


#: A candidate's features: expressions over hit, before and after (the context on either side) and the generator's number.
FEATURES = {
    "generator": "generator",
    "n_digits": "char_length(regexp_replace(hit, '[^0-9]', ''))",
    "n_letters": "char_length(regexp_replace(hit, '[^A-Za-z]', ''))",
    "length": "char_length(hit)",
    "groups": r"size(split(trim(hit), '[^0-9A-Za-z]+'))",
    "spaces": "char_length(hit) - char_length(replace(hit, ' ', ''))",
    "hyphens": "char_length(hit) - char_length(replace(hit, '-', ''))",
    "dots": "char_length(hit) - char_length(replace(hit, '.', ''))",
    "parenthesis": "cast(hit like '%(%' as int)",
    "national": r"cast(hit rlike '^\\(?[0-9]{3}\\)?[\\x20.-]{1,2}[0-9]{3}[\\x20.-][0-9]{4}$' as int)",
    "social": "cast(hit rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' as int)",
    "date": r"cast(hit rlike '^(?:19|20)[0-9]{2}[\\x20.-][0-9]{2}[\\x20.-][0-9]{2}|^[0-9]{2}[\\x20.-][0-9]{2}[\\x20.-](?:19|20)[0-9]{2}' as int)",
    "marked_dot": r"cast(hit rlike '(?i)[\\[({]dot[\\])}]|[a-z0-9]\\.[a-z]{2,}$' as int)",
    "marked_at": r"cast(hit rlike '(?i)[\\[({]at[\\])}]' as int)",
    "distinct": "size(array_distinct(split(regexp_replace(hit, '[^0-9]', ''), '')))",
    "word_before": f"cast(before rlike '{_WORDS}' as int)".replace("\\b", "\\\\b"),
    "label_before": r"cast(before rlike '[:=#]\\x20?$' as int)",
    "slashes": "char_length(hit) - char_length(replace(hit, '/', ''))",
    "colons": "char_length(hit) - char_length(replace(hit, ':', ''))",
    "born_before": f"cast(before rlike '{_BORN}' as int)".replace("\\b", "\\\\b"),
    "device_before": f"cast(before rlike '{_MAC}' as int)".replace("\\b", "\\\\b"),
    "unit_after": f"cast(after rlike '{_UNIT}' as int)".replace("\\x", "\\\\x"),
    "extension_after": r"cast(after rlike '(?i)^,?\\x20?(?:ext|x)\\.?\\x20?[0-9]' as int)",
    "money_before": r"cast(before rlike '[$€£]\\x20?$' as int)",
}


def features(hit: str, before: str, after: str, generator: str) -> str:
    """SQL of the features of one candidate, an array of doubles; the arguments are SQL expressions."""
    put = {"hit": hit, "before": before, "after": after, "generator": generator}
    parts = (re.sub(r"\b(hit|before|after|generator)\b(?=[ ,)]|$)", lambda m: put[m.group(1)], e) for e in FEATURES.values())
    return "array(" + ", ".join(f"cast({p} as double)" for p in parts) + ")"


def examples(n: int = 2400, seed: int = 17) -> list[dict]:
    """Labelled candidates made by rule: hit, before, after, generator, y."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 9)))
    plain = lambda: " ".join(name() for _ in range(4)) + " "
    said = lambda words: plain()[: r.randint(4, 20)] + " " + r.choice(words) + r.choice([": ", " ", "= ", " # "])
    tel, post, bank = ["tel", "phone", "call", "fax", "mobile", "cell", "reach us", "contact"], ["mail", "email", "write", "contact"], ["iban", "account", "acct"]
    born, link, thing = ["born", "birth", "birthday", "dob"], ["mac", "ipv6", "device", "interface"], ["item", "order", "total", "part", "version", "build", "page", "isbn", "serial"]
    day = lambda sep: r.choice([f"{r.randint(1900, 2030)}{sep}{r.randint(1, 12):02}{sep}{r.randint(1, 28):02}", f"{r.randint(1, 28)}{sep}{r.randint(1, 12)}{sep}{r.randint(1900, 2030)}"])
    group = lambda: (s := r.choice("-. ")) + d(3) + s + d(4)
    make = (
        (1, 0, lambda: (f"({d(3)}) {d(3)}-{d(4)}", said(tel) if r.random() < 0.8 else plain())),
        (1, 0, lambda: (f"{d(3)}{group()}", said(tel))),
        (1, 0, lambda: (f"0{d(r.randint(2, 4))}{r.choice(' -')}{d(r.randint(5, 8))}", said(tel))),
        (1, 0, lambda: (f"{d(3)}-{d(2)}-{d(4)}", said(["ssn", "social security"]) if r.random() < 0.8 else plain())),
        (1, 0, lambda: (d(r.randint(9, 11)), said(tel))),
        (1, 0, lambda: (d(9), said(["passport"]))),
        (1, 1, lambda: (f"{name()} [at] {name()} [dot] com" if r.random() < 0.5 else f"{name()}(at){name()}.org", said(post) if r.random() < 0.5 else plain())),
        (1, 1, lambda: (f"{name()}.{name()} at {name()} dot {r.choice(['com', 'net', 'org', 'de'])}", said(post))),
        (1, 2, lambda: (r.choice(["DE", "FR", "ES", "GB", "IT", "NL"]) + d(2) + "".join(f"{r.choice([' ', ''])}{d(4)}" for _ in range(r.randint(3, 5))), said(bank) if r.random() < 0.7 else plain())),
        (1, 3, lambda: (day(r.choice("./-")), said(born))),
        (1, 0, lambda: (day(r.choice(".-")), said(born))),
        (1, 4, lambda: ((r.choice(":-") if r.random() < 0.5 else ":").join(hexes(2) for _ in range(6)), said(link) if r.random() < 0.7 else plain())),
        (1, 4, lambda: (":".join(hexes(r.randint(1, 4)) for _ in range(8)), said(link) if r.random() < 0.7 else plain())),
        (0, 0, lambda: (d(r.randint(7, 19)), plain())),
        (0, 0, lambda: (d(r.randint(7, 19)), said(thing))),
        (0, 0, lambda: (d(r.randint(7, 10)), said(tel) if r.random() < 0.3 else plain())),
        (0, 0, lambda: (day(r.choice(".-")), plain() if r.random() < 0.6 else said(thing))),
        (0, 0, lambda: (" ".join(d(r.randint(1, 5)) for _ in range(r.randint(3, 5))), plain())),
        (0, 0, lambda: (f"{d(3)} {d(3)} {d(4)}", plain())),
        (0, 0, lambda: ("-".join(d(r.randint(1, 4)) for _ in range(4)), said(thing))),
        (0, 0, lambda: (f"{d(r.randint(4, 6))}.{d(r.randint(3, 6))}", plain() + r.choice("$€£"))),
        (0, 1, lambda: (f"{name()} at {name()} dot {name()}", plain())),
        (0, 1, lambda: (f"{name()} at {name()}.{name()}", plain())),
        (0, 2, lambda: (r.choice(["AB", "XK", "TR"]) + d(2) + "".join(r.choice("ABCDEF0123456789") for _ in range(14)), plain())),
        (0, 3, lambda: (day(r.choice("./-")), plain() if r.random() < 0.6 else said(thing + tel))),
        (0, 3, lambda: (f"{d(r.randint(1, 2))}.{d(r.randint(1, 2))}.{d(2)}", said(thing))),
        (0, 4, lambda: ("-".join(d(r.randint(1, 4)) for _ in range(6)), plain() if r.random() < 0.5 else said(thing))),
        (0, 4, lambda: (":".join(d(2) for _ in range(6)), plain())),
    )
    units = ["units", "items", "kg", "dollars", "%", "times", "bytes"]
    out = []
    for i in range(n):
        y, g, f = make[i % len(make)]
        hit, before = f()
        after = r.choice([" ", ", ", ". ", ") ", " or "]) + name()
        if g == 0 and not y and r.random() < 0.4:
            after = " " + r.choice(units)
        elif g == 0 and y and r.random() < 0.15:
            after = r.choice([" ext. ", " x", ", ext "]) + d(3)
        out.append({"hit": hit, "before": before[-CONTEXT:], "after": after[:CONTEXT], "generator": g, "y": y, "fold": int(i // len(make) % 4 == 0)})
    return out


@dataclass
class BoostedTrees:
    """Trees of depth two as (feature, cut, (feature, cut, low, high), (feature, cut, low, high))."""

    bias: float
    trees: list[tuple]
    thresholds: list[float]

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float, float]:
        best = (0, float("inf"), 0.0)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= cut
                a, b = h[low].sum(), h[~low].sum()
                if min(a, b) >= 0.5:
                    gain = g[low].sum() ** 2 / (a + 1) + g[~low].sum() ** 2 / (b + 1) - whole
                    if gain > best[2] + 1e-9:
                        best = (f, float(cut), float(gain))
        return best

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.4) -> BoostedTrees:
        mean = y.mean()
        model = BoostedTrees(float(np.log(mean / (1 - mean))), [], [])
        z = np.full(len(y), model.bias)
        leaf = lambda g, h: round(float(-rate * g.sum() / (h.sum() + 1)), 6)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            f, cut, gain = BoostedTrees._split(x, g, h)
            if not gain:
                break
            sides = []
            for side in (x[:, f] <= cut, x[:, f] > cut):
                f2, cut2, _ = BoostedTrees._split(x[side], g[side], h[side])
                low = x[:, f2] <= cut2
                sides.append((f2, cut2 if cut2 < 1e300 else 1e300, leaf(g[side & low], h[side & low]), leaf(g[side & ~low], h[side & ~low])))
            model.trees.append((f, cut, *sides))
            z = model.score(x)
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, cut, *sides in self.trees:
            low, high = (np.where(x[:, g] <= c, a, b) for g, c, a, b in sides)
            z += np.where(x[:, f] <= cut, low, high)
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float = 0.995) -> None:
        """For each generator, the least score above which held-back examples are right this often (none: never)."""
        z = self.score(x)
        for g in range(len(GENERATORS)):
            own = x[:, 0] == g
            fit = [t for t in np.unique(z[own]) if y[own & (z >= t)].mean() >= precision and t > 0]
            self.thresholds.append(float(min(fit, default=1e300)))

    def sql(self, array: str) -> str:
        """Score minus threshold, over the name of an array of features."""
        at = lambda f, cut, a, b: f"CASE WHEN {array}[{f}] <= {cut!r}D THEN {a} ELSE {b} END"
        side = lambda s: at(s[0], s[1], f"{s[2]!r}D", f"{s[3]!r}D")
        trees = " + ".join(at(f, cut, side(low), side(high)) for f, cut, low, high in self.trees)
        least = " ".join(f"WHEN {g} THEN {t!r}D" for g, t in enumerate(self.thresholds))
        return f"{self.bias!r}D + {trees} - CASE cast({array}[0] as int) {least} END"


@cache
def _fitted(n: int) -> BoostedTrees:
    spark = SparkSession.active()
    text = json.dumps(examples(n))
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<hit:string,before:string,after:string,generator:int,y:int,fold:int>>")).alias("e"))
    got = rows.select(F.expr(features("e.hit", "e.before", "e.after", "e.generator")).alias("x"), "e.y", "e.fold").collect()  # n rows
    x, y, fold = (np.array([r[k] for r in got], dtype=float) for k in ("x", "y", "fold"))
    model = BoostedTrees.fit(x[fold == 0], y[fold == 0])
    model.calibrate(x[fold == 1], y[fold == 1])
    return model


#: What is told apart by place: base spans (generator -1) and candidates.
_PLACED = f"struct<start:int,end:int,generator:int,{_SPAN.split(',', 2)[2]}>"


def clear_of_base(base: Column, candidates: Column) -> Column:
    """The candidates that no base span overlaps, by start: by the furthest base end before each and the next base start."""
    most = (1 << 31) - 1
    before = lambda r, none: F.slice(F.concat(F.array(F.lit(none)), r), F.lit(1), F.size(r))
    last = lambda x: before(running(F.transform(x, lambda p: F.when(p["generator"] < 0, p["end"]).otherwise(-1)), F.greatest, -1), -1)
    starts = lambda x: running(F.transform(F.reverse(x), lambda p: F.when(p["generator"] < 0, p["start"]).otherwise(most)), F.least, most)
    after = lambda x: F.reverse(before(starts(x), most))
    free = lambda x: F.filter(
        F.zip_with(x, F.arrays_zip(last(x).alias("low"), after(x).alias("high")), lambda p, w: F.when((p["generator"] >= 0) & (p["start"] >= w["low"]) & (p["end"] <= w["high"]), p)), lambda p: p.isNotNull()
    )
    return F.get(F.transform(F.array(F.array_sort(F.concat(base, candidates))), free), F.lit(0))


def apart(candidates: Column) -> Column:
    """Of candidates by start, each that begins where the last one taken ends, or later.

    What is taken depends on all before: the aggregate's state is one number and a text of a letter an item, which is cheap to copy.
    """

    def add(s: Column, x: Column) -> Column:
        fits = x["start"] >= s["end"]
        return F.struct(F.when(fits, x["end"]).otherwise(s["end"]).alias("end"), F.concat(s["taken"], F.when(fits, "1").otherwise("0")).alias("taken"))

    def chosen(x: Column) -> Column:
        taken = F.aggregate(x, F.struct(F.lit(-1).alias("end"), F.lit("").alias("taken")), add, lambda s: s["taken"])
        return F.filter(F.zip_with(x, F.split(taken, ""), lambda p, t: F.when(t == "1", p)), lambda p: p.isNotNull())

    return F.get(F.transform(F.array(candidates), chosen), F.lit(0))


def personal_data(docs: DataFrame, n_examples: int = 2400) -> DataFrame:
    """doc_id, text, the base spans of each kind and spans: an array of (start, n, end, kind) in order.

    Base spans always stay. A candidate of the generators is added, with its generator's name as its kind, if no base span
    overlaps it, its score passes its generator's threshold, and no candidate that was taken before reaches into it (of those
    that start together the shortest comes first). A null text counts as empty. A text of any length is searched whole, in
    time that grows little faster than its length and its matches. Rows that repeat a doc_id are searched each on its own
    text. Other columns are passed over, whatever their names. An empty table gives an empty result. Nothing is shuffled.
    """
    model = _fitted(n_examples)
    rows = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns(base_columns(F.col("text")))
    placed = lambda s, g: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(g).alias("generator"), *(s[n].alias(n) for n in ("hit", "before", "after")))
    of = lambda g: lambda s: placed(s, g)  # noqa: E731  a second parameter would be given the place in the array
    found = [F.transform(only_if(F.col("text").rlike(need), find(F.col("text"), pattern)), of(g)) for g, (_, need, pattern) in enumerate(GENERATORS)]
    known = F.concat(*(F.transform(k, lambda s: placed(s, -1)) for k in KINDS))
    none = F.array().cast(f"array<{_PLACED}>")
    rows = rows.withColumn("candidates", F.concat(none, *found)).withColumn("known", F.concat(none, known))
    # texts without candidates are the most: they spend nothing on what follows
    rows = rows.withColumn("candidates", F.when(F.size("candidates") == 0, none).otherwise(clear_of_base(F.col("known"), F.col("candidates"))))
    x = features("c.hit", "c.before", "c.after", "c.generator")
    rows = rows.withColumn("scored", F.expr(f"transform(candidates, c -> struct(c, {x} as x))"))
    rows = rows.withColumn("scored", F.expr(f"transform(filter(scored, c -> {model.sql('c.x')} >= 0), c -> c.c)"))
    rows = rows.withColumn("scored", F.when(F.size("scored") == 0, none).otherwise(apart(F.col("scored"))))
    tag = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    names = F.array(*(F.lit(name) for name, *_ in GENERATORS))
    added = F.transform("scored", lambda s: F.struct(s["start"].alias("start"), (s["generator"] + len(KINDS)).alias("n"), s["end"].alias("end"), F.get(names, s["generator"]).alias("kind")))
    rows = rows.withColumn("base", F.array_sort(F.concat(*map(tag, KINDS))))
    return rows.withColumn("spans", F.array_sort(F.concat(F.col("base"), added))).select("doc_id", "text", *KINDS, "base", "spans")


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read_table(spark, sf_dir, "documents"))
    number = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *number, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
