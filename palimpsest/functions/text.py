"""Text as column expressions: tokens, stems, keys, overlaps and scores."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-zA-Z0-9]{2,}|[\x{4e00}-\x{9fff}]{2,}"
# Words that a question does not ask about, and names of one thing.
SEMANTIC_STOPWORDS = ("a", "an", "are", "at", "be", "current", "currently", "do", "does", "for", "how", "in", "is", "my", "now", "of", "on", "the", "to", "what", "when", "where", "which", "who")
QUERY_STOPWORDS = ("what", "which", "when", "where", "who", "whom", "whose", "why", "how", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "should", "could", "would", "can", "our", "your", "their", "my", "the", "a", "an", "this", "that", "these", "those", "i", "we", "you")
DIRECT_LOCATION = r"^(?:请问)?([\x{4e00}-\x{9fff}]{2,12}?)(?:现在|目前|当前)?(住|居住|位于|运行|部署|工作|生活|存放)?(?:在哪里|在哪儿|在哪|身处何地|位于何处|在何处)[?？!！。]?$"
ALIASES = {
    "answer": "reply", "answers": "reply", "brief": "concise", "commands": "command", "deployment": "deploy", "deployments": "deploy", "direct": "concise",
    "like": "prefer", "likes": "prefer", "preference": "prefer", "preferences": "prefer", "prefers": "prefer", "production": "prod", "release": "deploy",
    "releases": "deploy", "replies": "reply", "response": "reply", "responses": "reply", "short": "concise", "restarts": "restart", "rollout": "deploy",
    "rollouts": "deploy", "ship": "deploy", "shipping": "deploy", "tone": "style", "uses": "use",
}
# Words that a CJK question is divided at.
CJK_STOPWORDS = ("一个", "什么", "哪个", "哪里", "哪", "哪儿", "何处", "为什么", "以及", "当前", "告诉", "告诉我", "多少", "如今", "怎么", "怎样", "是否", "是不是", "是", "有没有", "最近", "核验", "现在", "的", "请", "目前", "还是", "这个", "那个", "或者")
# What a target adds, and what is trivial, secret, of the present or of the past.
TARGET_BONUS = {"user": 0.08, "memory": 0.06, "project": 0.055, "ops": 0.055, "general": -0.04}
TRIVIAL = r"(?i)^(?:ok|okay|kk|k|yes|no|yep|nope|sure|thanks|thank you|thx|ty|got it|roger|understood|noted|acknowledged|done|hi|hello|hey|yo|早|早安|你好|嗨|在吗|在嗎|谢谢|謝謝|收到|明白|明白了|了解|了解了|好的|好)[!！,.。?？~\s]*$"
SECRET = r"(?i)(?:api[_-]?key|token|secret|password|passwd|private[_-]?key)\s*[:=]\s*[^\s]+"
CURRENT_STATE = r"(?:\b(?:current|currently|latest|newest|now|today)\b|当前|目前|现在|如今|最新)"
HISTORICAL_STATE = r"(?:\b(?:previously|before|history|historical|formerly|used\s+to|as\s+of)\b|之前|以前|过去|当时|曾经|历史|原来)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values: Iterable[str]) -> Column:
    """A fixed array of texts."""
    return F.split(F.lit("\n".join(values)), "\n")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def all_tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def cjk_segments(token: Column, most: int = 11) -> Column:
    """Search terms of a long CJK run: its pieces between stop words, and their 2- and 3-grams, longest first.

    Two-letter terms within a longer one are dropped.
    """
    pattern = "|".join(sorted(CJK_STOPWORDS, key=len, reverse=True))
    grams = lambda pieces, n: F.flatten(F.transform(F.filter(pieces, lambda p: F.char_length(p) > n), lambda p: F.regexp_extract_all(p, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))))
    known = lambda pieces: F.array_except(F.array_distinct(F.concat(pieces, grams(pieces, 2), grams(pieces, 3))), F.concat(F.array(token), words(CJK_STOPWORDS)))
    alone = lambda terms: F.filter(terms, lambda t: (F.char_length(t) > 2) | ~F.exists(terms, lambda o: (F.char_length(o) > F.char_length(t)) & F.contains(o, t)))
    placed = lambda terms: F.array_sort(F.transform(terms, lambda t: F.named_struct(F.lit("a"), -F.char_length(t), F.lit("b"), F.instr(token, t), F.lit("t"), t)))
    pieces = F.filter(F.split(F.regexp_replace(token, pattern, " "), " +"), lambda p: F.char_length(p) >= 2)
    out = F.slice(F.transform(placed(let(let(pieces, known), alone)), lambda s: s["t"]), 1, most)
    return F.when((F.char_length(token) >= 4) & token.rlike(r"^[\x{4e00}-\x{9fff}]+$"), out).otherwise(F.array().cast("array<string>"))


def query_tokens(text: str | Column) -> Column:
    """Words of two letters or more in order, each once; a long CJK run is followed by its segments."""
    long_run = F.coalesce(col(text), F.lit("")).rlike(r"[\x{4e00}-\x{9fff}]{4,}")
    divided = lambda found: F.when(long_run, F.flatten(F.transform(found, lambda t: F.concat(F.array(t), cjk_segments(t))))).otherwise(found)
    return F.array_distinct(let(all_tokens(text), divided))


def semantic_tokens(text: str | Column, known: Column | None = None) -> Column:
    """The tokens that a question is about, of its ``known`` tokens. A plain CJK question for a place is about its subject and its verb."""
    stop = words((*SEMANTIC_STOPWORDS, *CJK_STOPWORDS))
    has = lambda t, some: F.exists(words(some), lambda w: F.contains(t, w))
    divided = lambda t, known: t.rlike(r"^[\x{4e00}-\x{9fff}]{4,}$") & has(t, CJK_STOPWORDS) & F.exists(known, lambda o: (o != t) & (F.char_length(o) >= 2) & F.contains(t, o))
    about = lambda known: F.filter(F.array_except(known, stop), lambda t: ~divided(t, known))
    whole = clean_text(text)
    verb = F.regexp_extract(whole, DIRECT_LOCATION, 2)
    place = F.array(F.regexp_extract(whole, DIRECT_LOCATION, 1), F.when(verb.isin("住", "居住"), "住在").otherwise(verb))
    return F.when(whole.rlike(DIRECT_LOCATION), F.array_distinct(F.filter(place, lambda t: t != ""))).otherwise(let(query_tokens(text) if known is None else known, about))


def stem(token: Column) -> Column:
    """An English token without its ies, ing, ed, es or s; others as they are."""
    n = F.char_length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    single = lambda s: F.when((F.char_length(s) >= 2) & (F.right(s, F.lit(1)) == F.substring(s, -2, 1)), F.left(s, F.char_length(s) - 1)).otherwise(s)
    word = (
        F.when((n > 4) & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & token.endswith("ing"), single(cut(3)))
        .when((n > 3) & token.endswith("ed"), single(cut(2)))
        .when((n > 4) & token.rlike("(?<!s|x|z|ch|sh)es$"), cut(1))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), cut(1))
        .otherwise(token)
    )
    return F.when(token.rlike("^[a-zA-Z]+$"), word).otherwise(token)


def aliased(token: Column) -> Column:
    table = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in ALIASES.items())))
    return F.coalesce(F.element_at(table, token), token)


def normalized(tokens: Column) -> Column:
    """Tokens and their stems, each once."""
    return let(tokens, lambda ts: F.array_distinct(F.concat(ts, F.transform(ts, stem))))


def canonical(tokens: Column) -> Column:
    return F.array_distinct(F.transform(normalized(tokens), aliased))


def dedup_key(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col(text), F.lit("")))), r"\s+", " ")


def clean_text(text: str | Column) -> Column:
    """Without injected context blocks."""
    out = F.coalesce(col(text), F.lit(""))
    for tag in ("memory-context", "supermemory-context"):
        out = F.regexp_replace(out, rf"(?i)<{tag}>[\s\S]*?</{tag}>\s*", "")
    return F.trim(out)


def compact(text: str | Column, most: int) -> Column:
    """Runs of white space as one blank, and an ellipsis where the text is cut."""
    flat = F.regexp_replace(F.trim(F.coalesce(col(text), F.lit(""))), r"\s+", " ")
    if most <= 0:
        return F.lit("")
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(max(1, most - 1)))), F.lit("…")))


def is_trivial(text: str | Column) -> Column:
    return F.trim(F.coalesce(col(text), F.lit(""))).rlike(TRIVIAL)


def skip_retrieval(query: str | Column, least: int) -> Column:
    q = F.coalesce(col(query), F.lit(""))
    return (q == "") | is_trivial(q) | (F.char_length(q) < least)


def overlap_share(part: Column, whole: Column) -> Column:
    return F.size(F.array_intersect(part, whole)) / F.greatest(F.size(part), F.lit(1))


def informative(query_set: Column) -> Column:
    """The canonical query words that carry meaning; all of them if none does."""
    left = lambda q: F.array_except(q, words(QUERY_STOPWORDS))
    return let(query_set, lambda q: let(left(q), lambda x: F.when(F.size(x) > 0, x).otherwise(q)))


def lexical_score(query: Column, share: Column, haystack: Column, source: Column, target: Column, intent: Column) -> Column:
    """``share`` of the informative query words found, with bonuses for phrase, intent, source and target; 0 to 1."""
    phrase = F.when((query != "") & F.contains(haystack, F.lower(query)), 0.35).otherwise(0.0)
    origin = F.when(source == "builtin-curated", 0.18).when(source.startswith("tool"), 0.08).otherwise(0.02)
    bonus = F.lit(0.0)
    for name, value in TARGET_BONUS.items():
        bonus = F.when(target == name, value).otherwise(bonus)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.72 * share + phrase + F.when(intent, 0.18).otherwise(0.0) + origin + bonus))


def similarity(left: Column, right: Column) -> Column:
    """Of two canonical token sets: the larger of Jaccard's index and 0.82 of the containment; 0 if one is empty."""
    def score(p: Column) -> Column:
        both, a, b = F.size(F.array_intersect(p["a"], p["b"])), F.size(p["a"]), F.size(p["b"])
        return F.when((a == 0) | (b == 0), 0.0).otherwise(F.greatest(both / (a + b - both), 0.82 * both / F.least(a, b)))

    return let(F.struct(left.alias("a"), right.alias("b")), score)


def weighted_overlap(query: Column, documents: Column) -> Column:
    """Share of the query's words found, weighted by their length between 2 and 8; a phrase counts fully."""
    q, hay = F.lower(clean_text(query)), F.lower(documents)
    weight = lambda t: F.least(F.lit(8), F.greatest(F.lit(2), F.char_length(t)))

    def share(p: Column) -> Column:
        total = F.aggregate(p["words"], F.lit(0), lambda s, t: s + weight(t))
        found = F.aggregate(F.filter(p["words"], lambda t: F.contains(p["hay"], t) | F.array_contains(p["known"], stem(t))), F.lit(0), lambda s, t: s + weight(t))
        return F.when(total > 0, found / total).otherwise(0.0)

    parts = F.struct(semantic_tokens(q).alias("words"), normalized(query_tokens(hay)).alias("known"), hay.alias("hay"))
    return F.when((q == "") | F.contains(hay, q), 1.0).otherwise(let(parts, share))


def coverage(text: Column, terms: Column) -> Column:
    """Share of required terms that a text holds; 1 if none is required."""
    hits = F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t)))
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(hits) / F.size(terms))


def ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of characters, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def cjk_score(matched_trigrams: Column, matched_bigrams: Column) -> Column:
    hits = matched_trigrams + matched_bigrams
    return F.when((matched_trigrams < 1) & (matched_bigrams < 2), 0.0).otherwise(F.least(F.lit(0.5), 0.12 + 0.04 * F.least(hits, F.lit(6))))


def urls(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"https?://[^\s\"'<>)\]]+"), F.lit(0)))


def redact_secrets(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?i)\b(api[_-]?key|token|secret|password|passwd|private[_-]?key)\s*[:=]\s*[^\s]+", "$1=[REDACTED]")


def strip_html(html: str | Column) -> Column:
    """Visible text of a page: scripts, styles and tags go, white space is folded."""
    out = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def split_sentences(text: str | Column) -> Column:
    parts = F.split(F.coalesce(col(text), F.lit("")), r"[.!?。！？；;\n]+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


CJK_RUN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]+"


def all_cjk_ngrams(text: str | Column) -> Column:
    """Trigrams, then bigrams, of a text's CJK runs, each once."""
    grams = lambda runs, n: F.flatten(F.transform(runs, lambda r: ngrams(r, n)))
    runs = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(CJK_RUN), F.lit(0))
    return let(runs, lambda r: F.array_distinct(F.concat(grams(r, 3), grams(r, 2))))


def cjk_ngrams(query: str | Column, most: int = 24) -> Column:
    """The first of ``all_cjk_ngrams``, no more than ``most``."""
    return F.slice(all_cjk_ngrams(query), 1, most)


def trigram_terms(query: str | Column) -> Column:
    """What a trigram index is asked for: CJK trigrams, then words of three letters or more."""
    long = lambda ts: F.filter(ts, lambda t: F.char_length(t) >= 3)
    every = F.array_union(cjk_ngrams(query, 16), long(query_tokens(query)))
    return long(F.slice(every, 1, 24))


def cjk_substring_score(terms: Column, haystack: Column) -> Column:
    """Evidence of a text for CJK terms: nothing for less than one trigram or two bigrams."""
    held = lambda n: F.size(F.filter(terms, lambda t: (F.char_length(t) == n) & F.contains(haystack, t)))
    return cjk_score(held(3), held(2))


# Where private files lie, and how images and attachments are pasted.
PRIVATE_PATH = r"(^|[^A-Za-z0-9])(?:(?:/home|/Users|/root)/[^\s\]})>'\"]+|~/[^\s\]})>'\"]+|/tmp/(?:pytest|tmp)[^\s\]})>'\"]*|[A-Za-z]:[\\/][^\s\]})>'\"]+|%(?:TEMP|TMP|LOCALAPPDATA|APPDATA|USERPROFILE)%[\\/][^\s\]})>'\"]+)"
DATA_URL = r"(?i)data:[a-z0-9.+-]+/[a-z0-9.+-]+(?:;[a-z0-9.+_-]+=[^;,\s]+)*;base64,[A-Za-z0-9+/]*={0,2}"
ATTACHMENT = r"(?i)\[Image attached at:\s*[^\]]*\]|\[inline image/[^\]]*data omitted\]|\[screenshot\]"


def redact_paths(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), PRIVATE_PATH, "$1[REDACTED_PATH]")


def sanitized(text: str | Column) -> Column:
    """For reports: no data URLs, attachments, secrets or private paths."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), DATA_URL, " "), ATTACHMENT, "")
    return F.trim(redact_paths(redact_secrets(bare)))


def sanitize_json(value: str | Column) -> Column:
    """A JSON text with keys and values sanitised at every depth up to 16; what is no JSON is sanitised as text.

    Nesting has no column expression, so that values go through Arrow.
    """
    secret = re.compile(r"(?i)\b(api[_-]?key|token|secret|password|passwd|private[_-]?key)\s*[:=]\s*[^\s]+")
    path, url, attached = re.compile(PRIVATE_PATH), re.compile(DATA_URL), re.compile(ATTACHMENT)
    sensitive = re.compile(r"(?i)^(?:.*[_-])?(?:api[_-]?key|token|secret|password|passwd|private[_-]?key)$")

    def plain(s: str) -> str:
        s = secret.sub(lambda m: f"{m.group(1)}=[REDACTED]", attached.sub("", url.sub(" ", s)))
        return path.sub(lambda m: f"{m.group(1)}[REDACTED_PATH]", s).strip()

    def clean(v, depth: int = 0):
        if depth >= 16:
            return "[REDACTED_DEPTH_LIMIT]"
        if isinstance(v, dict):
            out: dict = {}
            for k, x in v.items():
                name = "[REDACTED_KEY]" if sensitive.match(k) else plain(k) or "[REDACTED_KEY]"
                n, key = 2, name
                while key in out:
                    n, key = n + 1, f"{name}#{n}"
                out[key] = clean(x, depth + 1)
            return out
        if isinstance(v, list):
            return [clean(x, depth + 1) for x in v]
        return plain(v) if isinstance(v, str) else v

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            try:
                return json.dumps(clean(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return plain(s)

        return values.map(one)

    return run(col(value))


# Sentences that state a preference, a command or an identity.
PREFERENCE = r"(?i)\b([A-Z][\w-]*|user|joy)\s+(?:prefers?|likes?|wants?|希望|喜欢|喜歡|偏好)\s+([^.!?。！？]+)"
DEPLOY = r"(?i)\b(?:(?:the\s+)?(?:current\s+)?(?:production|prod)\s+)?(?:deploy|deployment|rollout|release)\s+(?:command\s+)?(?:is|uses?|=)\s+([^.!?。！？]+)"
IDENTITY = r"(?i)\b([A-Z][\w-]*)\s+is\s+([^.!?。！？]+)"


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with ``\b`` between ASCII word letters and others, as ``\w`` has it; Java's own counts ó as a letter and ``\w`` does not."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def stated_facts(text: str | Column) -> Column:
    """(target, category, content) of every sentence that states a preference, a deploy command or an identity."""
    preference, deploy, identity = map(ascii_bounds, (PREFERENCE, DEPLOY, IDENTITY))
    marked = F.regexp_replace(F.trim(F.coalesce(col(text), F.lit(""))), r"([.!?。！？])\s+", "$1\n")
    sentences = F.transform(F.split(marked, r"[\n;；]+"), lambda s: F.rtrim(F.trim(s), F.lit(".!?。！？")))
    fact = lambda target, category, content: F.struct(F.lit(target).alias("target"), F.lit(category).alias("category"), compact(content, 360).alias("content"))
    said = lambda s: (
        F.when(s.rlike(preference), fact("user", "preference", F.concat(F.trim(F.regexp_extract(s, preference, 1)), F.lit(" prefers "), F.trim(F.regexp_extract(s, preference, 2)), F.lit("."))))
        .when(s.rlike(deploy), fact("ops", "procedure", F.concat(F.lit("Production deploy command is "), F.trim(F.regexp_extract(s, deploy, 1)), F.lit("."))))
        .when(s.rlike(identity) & (F.size(F.split(F.trim(s), r"\s+")) <= 18), fact("project", "fact", F.concat(s, F.lit("."))))
    )
    return F.array_compact(F.transform(F.filter(sentences, lambda s: s != ""), said))


ARTIFACT = r"https?://github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)(?:/(issues|pull|pulls|commit|releases/tag)/([^\s<>'\"\])}，。；、]+))?"


def artifacts(text: str | Column, most: int = 24) -> Column:
    """(kind, repo, item, url) of what a text links to, each once: issues, pulls, commits, releases, repositories and other URLs."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"https?://[^\s<>'\"\])}，。；、]+"), F.lit(0))
    bare = F.transform(found, lambda u: F.rtrim(u, F.lit(".,;:!?")))
    kinds = {"issues": "github_issue", "pull": "github_pull", "pulls": "github_pull", "commit": "github_commit", "releases/tag": "github_release"}

    def read(u: Column) -> Column:
        section, kind = F.regexp_extract(u, ARTIFACT, 2), F.lit("github_repo")
        for name, value in kinds.items():
            kind = F.when(section == name, value).otherwise(kind)
        hub = u.rlike(ARTIFACT)
        none = F.lit("")
        return F.struct(F.when(hub, kind).otherwise("url").alias("kind"), F.when(hub, F.regexp_extract(u, ARTIFACT, 1)).otherwise(none).alias("repo"), F.when(hub, F.regexp_extract(u, ARTIFACT, 3)).otherwise(none).alias("item"), u.alias("url"))

    return F.slice(F.array_distinct(F.transform(bare, read)), 1, most)
