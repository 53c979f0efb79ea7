"""What a question is after: place, operating system, time zone, the present; and whether a text answers in that shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CURRENT_STATE, HISTORICAL_STATE, clean_text, col, query_tokens, words

# How the intents are asked for, what they add to a search, and what counts as an answer.
LOCATION = r"(?:在哪里|在哪|哪儿|何处|什么位置)"
SYSTEM = r"(?:(?:跑|用|使用|运行).{0,4}(?:什么|哪个|哪种)(?:操作)?系统|(?:什么|哪个|哪种)(?:操作)?系统)"
TIMEZONE = r"(?i)(?:\btime\s*zone\b|\btimezone\b|时区)"
LOCATION_TERMS = ("位置", "地址", "路径", "目录", "主机", "本机", "运行环境")
SYSTEM_TERMS = ("操作系统", "运行环境", "主机", "本机", "windows", "linux", "macos")
TIMEZONE_TERMS = ("时区", "timezone", "time zone", "utc", "gmt")
TIMEZONE_SUBJECTS = ("工作电脑", "workstation", "电脑", "本机", "主机", "server")
_ZONE = r"(?:[a-z]+/[a-z0-9_+\-]+|\b(?:utc|gmt)(?:[+\-]\d{1,2}(?::?\d{2})?)?\b|美国东部时区|美国西部时区|东部时区|西部时区|北京时间)"
TIMEZONE_ANSWER = rf"(?is)(?:时区(?:偏好)?\s*[:：]?|使用|采用|设置(?:为|成)?|timezone\s*(?:is|:)|uses?).{{0,48}}{_ZONE}"
LOCATION_EVIDENCE = (*LOCATION_TERMS, "live root", "live根")
SYSTEM_EVIDENCE = (
    "操作系统", "运行环境", "windows", "linux", "macos", "debian", "ubuntu", "rocky linux", "rocky", "red hat", "rhel", "centos", "fedora", "alpine", "arch linux", "nixos", "freebsd", "wsl2", "wsl",
)
SYSTEM_ANSWER = (
    r"(?is)(?:(?:运行(?:在|于|的是)?|使用(?:的是)?|采用|基于|操作系统\s*(?:是|为|:|：)|系统\s*(?:是|为|:|：)|runs?\s+on|is\s+running|operating\s+system\s+is).{0,24})"
    r"(?:windows|linux|macos|debian|ubuntu|rocky(?:\s+linux)?|red\s+hat|rhel|centos|fedora|alpine|arch\s+linux|nixos|freebsd|wsl2?|[\x{4e00}-\x{9fff}]{2,8}(?:操作)?系统)\b"
)
FRESHNESS_HINTS = ("current", "currently", "latest", "new", "newest", "now", "recent", "recently", "today", "updated", "当前", "目前", "现在", "如今", "最新")
FRESHNESS_BASE, FRESHNESS_STEP, FRESHNESS_MOST = 0.03, 0.015, 0.06


def _if(condition: Column, values: Column) -> Column:
    return F.when(condition, values).otherwise(F.array().cast("array<string>"))


def intent_terms(query: str | Column) -> Column:
    """Terms that the question's intents add, each once."""
    q = F.lower(clean_text(query))
    return F.array_distinct(F.concat(_if(q.rlike(LOCATION), words(LOCATION_TERMS)), _if(q.rlike(SYSTEM), words(SYSTEM_TERMS)), _if(q.rlike(TIMEZONE), words(TIMEZONE_TERMS))))


def matched_terms(query: str | Column, document: str | Column) -> Column:
    """Evidence in a text that it has the shape of an answer to the question."""
    q, d = F.lower(clean_text(query)), F.lower(clean_text(document))
    within = lambda values: F.filter(words(values), lambda t: F.contains(d, t))
    system = q.rlike(SYSTEM) & (d.rlike(CURRENT_STATE) | d.rlike(SYSTEM_ANSWER))
    asked = F.filter(words(TIMEZONE_SUBJECTS), lambda t: F.contains(q, t))
    zone = q.rlike(TIMEZONE) & ((F.size(asked) == 0) | F.exists(asked, lambda t: F.contains(d, t))) & d.rlike(TIMEZONE_ANSWER)
    value = F.array(F.regexp_extract(d, _ZONE, 0))
    return F.array_distinct(F.concat(_if(q.rlike(LOCATION), within(LOCATION_EVIDENCE)), _if(system, within(SYSTEM_EVIDENCE)), _if(zone, F.concat(within(TIMEZONE_TERMS), value))))


def asks_current_state(query: str | Column) -> Column:
    q = F.lower(clean_text(query))
    return (q != "") & ~q.rlike(HISTORICAL_STATE) & (q.rlike(CURRENT_STATE) | q.rlike(LOCATION) | q.rlike(SYSTEM) | q.rlike(TIMEZONE))


def freshness_weight(query: str | Column, known: Column | None = None) -> Column:
    """How much a question wants what is new: by its hint words, or one for asking about the present."""
    hits = F.size(F.array_intersect(query_tokens(col(query)) if known is None else known, words(FRESHNESS_HINTS)))
    hits = F.when(hits > 0, hits).when(asks_current_state(query), 1).otherwise(0)
    return F.when(hits > 0, F.least(F.lit(FRESHNESS_MOST), FRESHNESS_BASE + FRESHNESS_STEP * hits)).otherwise(0.0)


def recency_bonus(base: Column, weight: Column, position: Column) -> Column:
    """What ``position`` between the oldest (0) and the newest (1) of the kept adds to a score."""
    return F.when(position.isNull() | (weight <= 0) | (base <= 0), 0.0).otherwise(F.least(weight * position * F.least(F.lit(1.0), base / 0.6), F.lit(0.06), 0.12 * base))
