import random
import time

from palimpsest.llm.rules import RULES, Rule, base_statistics, cascade_order, quality_rules, repeated_words


def brute(text):
    words, word, dup, repeat = [], "", 0, set()
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    lines = text.split("\n")
    for i, line in enumerate(lines):
        dup += line in lines[:i] and any(c not in " \t\n\x0b\x0c\r" for c in line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            repeat |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat)


def verdict(text, s):
    """The method's verdict, written out anew: true if a rule rejects."""
    words = text.split()
    upper, letters = sum(c.isupper() for c in text), sum(c.isalpha() for c in text)
    most = max((words.count(w) for w in set(words)), default=0)
    marks = len(text.replace("!!", "!! ").split("!!")) - 1 + len(text.replace("??", "?? ").split("??")) - 1
    return (
        (s[0] and s[2] / s[0] > 0.25) or (s[0] and not 2 <= s[1] / s[0] <= 25) or (s[3] > 3 and s[3] / len(text.split("\n")) > 0.5)
        or (upper > 20 and upper / letters > 0.5) or (len(words) >= 20 and most / len(words) > 1 / 3) or (len(words) >= 100 and len(set(words)) / len(words) < 0.1)
        or (s[0] and marks / s[0] > 1 / 3) or any(c * 30 in text for c in set(text))
    )


def faulty():
    """Texts of enough words that differ in one fault each."""
    rnd = random.Random(9)
    prose = lambda n: [f"{a}{b}" for a, b in zip(rnd.choices(["ba", "lo", "mi", "tes"], k=n), rnd.sample(range(1000, 9999), n))]
    out = [" ".join(prose(80)) for _ in range(6)]
    out += [" ".join(f"{w} #$" if i % 2 else w for i, w in enumerate(prose(80))), " ".join(f"{w}{w}{w}{w}{w}{w}{w}" for w in prose(60)), " ".join(prose(70)).upper()]
    out += ["\n".join(["one line here", *prose(20)] * 1 + [f"{w} x" for w in prose(12)] + ["same"] * 60), " ".join(w for p in prose(60) for w in (p, "the"))]
    out += [" ".join(f"{w}!!" for w in prose(60)), " ".join([*prose(60), "-" * 30]), " ".join([*prose(60), "-" * 29]), " ".join(rnd.choices("abcdefgh", k=400))]
    return out


def cases():
    rnd = random.Random(3)
    out = ["", " \n\t", "a", "a a a", "a a a a", "é ü 漢字 | # x\nx\n x\nx\n\n\n", "a b c a b c", "#$%&"]
    out += [" ".join(rnd.choice("abcd") for _ in range(n)) for n in range(60)]
    out += ["\n".join(" ".join(f"w{rnd.randrange(400)}" for _ in range(9)) for _ in range(20)) for _ in range(20)]
    return out


def test_statistics():
    for text in cases():
        assert base_statistics(text) == brute(text)
    assert repeated_words(["x"] * 100_000) == 100_000


def test_table(spark):
    rows = [(i % 50, t, True) for i, t in enumerate(cases() + faulty())] + [(1, None, False), (2, "word " * 100_000, False), (2, "word " * 100_000, False)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept boolean"), sample=20).collect()
    want = []
    for d, t, _ in rows:
        s = brute(t or "") if len(t or "") < 9999 else (100_000, 400_000, 0, 0, 100_000)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((d, *s, failed, not failed and not verdict(t, s)))
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r.kept for r in got) and not all(r.kept for r in got)


def test_order(spark):
    """By rejection per cost among texts that the base rules let through; the order never changes what is kept."""
    slow = lambda x: time.sleep(0.004) or "w3" in x.text
    rules = (Rule("never", lambda x: False), Rule("slow", slow), Rule("short", lambda x: x.base[0] < 50), Rule("rare", lambda x: "rare" in x.text), Rule("often", lambda x: "w1" in x.text))
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40, i % 40 + 60 if i % 3 else 20)) + (" rare" if i == 7 else "")) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    names = [r.name for r in cascade_order(docs, rules)]
    assert names[0] == "often" and names.index("rare") < names.index("slow") and set(names[3:]) == {"never", "short"}
    kept = lambda r: {x.doc_id: x.kept for x in quality_rules(docs, r).collect()}
    assert kept(rules) == kept(rules[::-1]) == {d: len(t.split()) >= 50 and not any(w in t for w in ("rare", "w1", "w3")) for d, t in rows}


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
