"""Evidence of typed relations, project scope and task closure in texts; CJK segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that state a relation.
TRIGGERS = {
    "depends_on": r"depends\s+on|requires?|依赖(?:于)?|取决于",
    "owned_by": r"owned\s+by|owner\s+is|maintained\s+by|belongs\s+to|归属|负责人",
    "affects": r"affects|impacts|changes|blocks|影响|阻塞",
    "invalidates": r"invalidates?|makes\s+obsolete|no\s+longer\s+valid|失效|废弃",
}
SUPERSEDES = r"supersedes?|replaces?|instead\s+of|取代|替代"
DENIAL = r"\b(?:not|never|no|doesn't|isn't)\s+(?:\w+\s+){0,2}$"
# Words that end a task well or badly.
FAILED = r"\b(?:failed|failure|error|broken|blocked)\b"
UNSURE = r"\b(?:maybe|unsure|unclear|not sure|might)\b"
COMPLETE = r"\b(?:done|completed|finished|fixed|deployed|resolved)\b"


def states(content: Column, relation: str, entity: Column) -> Column:
    """The content states a relation to the entity within the next 48 letters, and does not deny it."""
    after = F.concat(F.lit(rf"(?i)({DENIAL.rstrip('$')})?(?:{TRIGGERS[relation]})[^.!?。]{{0,48}}?"), F.regexp_replace(entity, r"([\\\[\](){}.*+?^$|])", r"\\$1"))
    hit = F.regexp(content, after)
    denied = F.length(F.call_function("regexp_extract", content, after, F.lit(1))) > 0
    return hit & ~denied


def projects(content: Column) -> Column:
    """Names that follow the word project, lower case, once each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(r"(?i)\bproject[\s:_-]+([a-z0-9][a-z0-9-]{1,40})"), F.lit(1)), lambda p: F.lower(p)))


def scope_mismatch(query: Column, content: Column) -> Column:
    """Both name projects, and none in common."""
    q, c = projects(query), projects(content)
    return (F.size(q) > 0) & (F.size(c) > 0) & ~F.arrays_overlap(q, c)


def closure(all_text: Column, tail: Column) -> Column:
    """How a task ended: what its last turns say comes before what was said on the way."""
    return (
        F.when(tail.rlike(f"(?i){FAILED}"), "failed").when(tail.rlike(f"(?i){UNSURE}"), "uncertain").when(tail.rlike(f"(?i){COMPLETE}"), "success")
        .when(all_text.rlike(f"(?i){FAILED}"), "uncertain").otherwise("unknown")
    )
