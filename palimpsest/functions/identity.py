"""Identity of facts: keys and fingerprints that survive case, width and white space."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: str | None) -> str:
    """NFKC, white space folded, full case folding: more than lower() can do."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "")).strip().casefold()


def fold(text: str | Column) -> Column:
    """normalized() of a column, by Arrow batches: Spark has neither NFKC nor full case folding."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normalized)

    return run(text)


def fact_key(subject: str, predicate: str) -> str:
    return json.dumps([normalized(subject), normalized(predicate)], ensure_ascii=False, separators=(",", ":"))


def fact_fingerprint(subject: str, predicate: str, value: str) -> str:
    body = json.dumps([normalized(subject), normalized(predicate), normalized(value)], ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()


def fingerprint(subject: Column, predicate: Column, value: Column) -> Column:
    """The fingerprint of folded columns, in the JVM."""
    return F.sha2(F.to_json(F.array(subject, predicate, value)), 256)


def local_instant(text: str, zone: str) -> datetime:
    """A local time as UTC; ValueError where the clock shows it twice or never."""
    at = datetime.fromisoformat(text)
    if at.tzinfo is not None:
        return at.astimezone(timezone.utc)
    tz = ZoneInfo(zone)
    early, late = (at.replace(tzinfo=tz, fold=k) for k in (0, 1))
    back = early.astimezone(timezone.utc).astimezone(tz).replace(tzinfo=None)
    if back != at:
        raise ValueError(f"{text} does not exist in {zone}")
    if early.utcoffset() != late.utcoffset():
        raise ValueError(f"{text} is ambiguous in {zone}")
    return early.astimezone(timezone.utc)
