"""Deterministic outputs: canonical JSON, containers, event lines."""

from __future__ import annotations

import io
import json
import math
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIMETYPE = "application/epub+zip"
EPOCH = (1980, 1, 1, 0, 0, 0)


def canonical_json(value, first: str = "ir_version") -> str:
    """Sorted keys with one ahead, numbers at two places; a number that isn't finite is an error."""

    def clean(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("a number that isn't finite")
            return round(v, 2) + 0.0
        if isinstance(v, dict):
            return {k: clean(v[k]) for k in sorted(v, key=lambda k: (k != first, k))}
        return [clean(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(clean(value), ensure_ascii=False, separators=(",", ":"))


def canonical_rows(df: DataFrame, first: str = "ir_version") -> Column:
    """A row as canonical JSON: one column ahead, the others by name, numbers at two places, nulls written; a number that isn't finite is an error."""
    names = sorted(df.columns, key=lambda c: (c != first, c))
    kinds = dict(df.dtypes)

    def clean(c: str) -> Column:
        if kinds[c] not in ("double", "float"):
            return F.col(c)
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, F.raise_error(F.lit("a number that isn't finite")).cast("double")).otherwise(F.round(c, 2)).alias(c)

    return F.to_json(F.struct(*[clean(c) for c in names]), {"ignoreNullFields": "false"})


def deterministic_zip(entries: dict[str, bytes]) -> bytes:
    """A container whose bytes depend on its entries only: the media type first and stored, the others by name, one date."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ["mimetype", *sorted(k for k in entries if k != "mimetype")]:
            info = zipfile.ZipInfo(name, EPOCH)
            info.external_attr = 0o644 << 16
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, MIMETYPE if name == "mimetype" else entries[name])
    return out.getvalue()


def read_entries(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {i.filename: z.read(i) for i in z.infolist()}


def container_findings(data: bytes) -> list[tuple[str, str]]:
    """(id, name) of what is wrong with a container: media type not first, or compressed; names that differ in case only; no container file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
    found = []
    if not infos or infos[0].filename != "mimetype":
        found.append(("mimetype_not_first", "mimetype"))
    elif infos[0].compress_type != zipfile.ZIP_STORED:
        found.append(("mimetype_compressed", "mimetype"))
    names = [i.filename for i in infos]
    if "META-INF/container.xml" not in names:
        found.append(("container_missing", "META-INF/container.xml"))
    seen: dict[str, str] = {}
    for n in names:
        if n.lower() in seen:
            found.append(("name_collision", n))
        seen[n.lower()] = n
    return found


def event_lines(events: DataFrame, most: int = 65_536) -> DataFrame:
    """(job, seq, line): events (job, ts_ms, t, payload) as JSON lines with a version, numbered within a job; a longer line loses its payload."""
    seq = F.expr("row_number() over (partition by job order by ts_ms, t) - 1")
    rows = events.withColumn("seq", seq)
    full = F.to_json(F.struct(F.lit(1).alias("v"), "t", "seq", "ts_ms", "payload"))
    short = F.to_json(F.struct(F.lit(1).alias("v"), "t", "seq", "ts_ms", F.lit(True).alias("truncated")))
    return rows.select("job", "seq", F.when(F.octet_length(full) <= most, full).otherwise(short).alias("line"))


def cache_key(*parts: Column) -> Column:
    """A digest of parts with their lengths, so that no two lists of parts share one."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(";"))]).cast("binary"), 256)
