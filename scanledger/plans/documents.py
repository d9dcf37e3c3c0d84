"""Whole documents per repo (comment bodies, JSON exports, SARIF upload bodies) from ordered fragments.

A document is a set of fragments (repo, k1, k2, k3, text): its opening, a row a finding, what opens and closes each
section, its end. Prefix sums of their bytes give every fragment its place in the document, and fragments whose place
falls in the same CHUNK become one part. So a repo with most of the findings is written by many tasks, and its parts,
in order, are the document byte for byte.
"""

from __future__ import annotations

import struct
import sys
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.functions.severity import REPORTED_SEVERITIES
from scanledger.operators.aggregates import severity_counts
from scanledger.operators.packing import prefix_sums
from scanledger.operators.triage import FINDING_FIELDS
from scanledger.plans.reports import TOOL_NAME, json_rows, json_summaries, pr_comment_rows, pr_comment_sections, pr_comment_summary, sarif_document_parts

# the encoder travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a document in one part, about.
CHUNK = 1 << 20

def _level(c: F.Column) -> F.Column:
    """1 for the first reported severity, and so on."""
    return F.array_position(F.array(*[F.lit(s) for s in REPORTED_SEVERITIES]), c).cast("int")


def _fragment(df: DataFrame, k1, k2: int, k3, text: F.Column) -> DataFrame:
    at = lambda k: (k if isinstance(k, F.Column) else F.lit(k))
    return df.select("repo", at(k1).cast("int").alias("k1"), F.lit(k2).alias("k2"), at(k3).cast("bigint").alias("k3"), text.alias("text"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------------- places and parts


def placed(fragments: DataFrame) -> DataFrame:
    """(repo, position, offset, text): each fragment's number and the byte at which it begins in its document."""
    rows = prefix_sums(fragments, "repo", [c for c in ("k1", "k2", "k3", "k4") if c in fragments.columns], F.octet_length("text"))
    return rows.select("repo", "position", "offset", "text")


def parts(fragments: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(repo, part, offset, text): the document in parts of about ``chunk`` bytes; what is collected is one part."""
    rows = placed(fragments).withColumn("part", F.floor(F.col("offset") / chunk))
    held = rows.groupBy("repo", "part").agg(F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("position", "text"))).alias("f"))
    return held.select("repo", "part", "offset", F.array_join(F.transform("f", lambda x: x["text"]), "").alias("text"))


def write_documents(fragments: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Each repo's document under ``path/repo=<repo>/``: files in name order, and their lines, hold its parts in order.

    A line is a JSON object (part, offset, text), as the document's own newlines would end a text line.
    """
    rows = parts(fragments, chunk).select("repo", "part", F.to_json(F.struct("part", "offset", "text")).alias("value"))
    spread = rows.repartitionByRange("repo", "part").sortWithinPartitions("repo", "part")
    spread.select("repo", "value").write.mode("overwrite").partitionBy("repo").text(path)


# --------------------------------------------------------------------------- PR comment


def comment_fragments(df: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Fragments of each repo's comment: header, sections with their tables and ends, footer; the header alone if clean."""
    summary = pr_comment_summary(df, scans)
    sections = pr_comment_sections(df)
    level = _level(F.col("severity"))
    footer = F.lit(f"\n---\n<sub>Generated by {TOOL_NAME}</sub>\n")
    return _union(
        _fragment(summary, 0, 0, 0, F.col("header")),
        _fragment(sections, level, 0, 0, F.col("section_head")),
        _fragment(pr_comment_rows(df), level, 1, F.col("ingest_seq"), F.concat("row", F.lit("\n"))),
        _fragment(sections, level, 2, 0, F.lit("\n</details>\n\n")),
        _fragment(summary.where("shown > 0"), len(REPORTED_SEVERITIES) + 1, 0, 0, footer),
    )


# --------------------------------------------------------------------------- JSON export


def quoted(c: F.Column) -> F.Column:
    """A JSON string in ASCII: quotes, backslashes, control and other characters escaped; null for a null."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(ch: F.Column) -> F.Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1")
        out = F.when(ch.rlike(r"^[\x20-\x7E]$"), ch).otherwise(units)
        for plain, escaped in short.items():
            out = F.when(ch == plain, F.lit(escaped)).otherwise(out)
        return out

    odd = c.rlike(r'[^\x20-\x7E]|["\\]')
    text = F.when(odd, F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def json_fragments(df: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Fragments of each repo's JSON document: summary, counts, and a list of findings for each reported severity."""
    head = json_summaries(df, scans)
    opening = F.concat(F.lit('{\n  "summary": '), quoted(F.col("summary")), *[x for c in ("raw_count", "triaged_count") for x in (F.lit(f',\n  "{c}": '), F.col(c).cast("string"))])
    counts = severity_counts(df, scans).select("repo", F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s.lower()).alias("n")) for s in REPORTED_SEVERITIES])).alias("s")).select("repo", "s.*")
    name = F.lower("severity")
    rows = json_rows(df, with_seq=True)
    first = rows.groupBy("repo", "severity").agg(F.min("ingest_seq").alias("first"))
    rows = rows.join(first, ["repo", "severity"])
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")) if c == "line" else quoted(F.col(c))
    fields = [x for i, c in enumerate(FINDING_FIELDS) for x in (F.lit(f'{"," if i else ""}\n      "{c}": '), value(c))]
    item = F.concat(F.when(F.col("ingest_seq") == F.col("first"), F.lit("\n    {")).otherwise(F.lit(",\n    {")), *fields, F.lit("\n    }"))
    level = _level(F.col("severity"))
    return _union(
        _fragment(head, 0, 0, 0, opening),
        _fragment(counts, level, 0, 0, F.concat(F.lit(',\n  "'), name, F.lit('": ['))),
        _fragment(rows, level, 1, F.col("ingest_seq"), item),
        _fragment(counts, level, 2, 0, F.when(F.col("n") > 0, F.lit("\n  ]")).otherwise(F.lit("]"))),
        _fragment(head, len(REPORTED_SEVERITIES) + 1, 0, 0, F.lit("\n}")),
    )


# --------------------------------------------------------------------------- SARIF upload body


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose length is a multiple of 3: a comment of up to one character in its header fills it up."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    comment = [b"", b"\0", b" \0"][-(len(body) + 18) % 3]
    header = b"\x1f\x8b\x08" + bytes([16 if comment else 0]) + struct.pack("<L", 0) + b"\x00\xff" + comment
    return header + body + struct.pack("<LL", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _members(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            member = gzip_member((row.column("text")[0].as_py() or "").encode())
            yield pa.RecordBatch.from_arrays([row.column("repo"), row.column("part"), pa.array([member], pa.binary())], names=["repo", "part", "member"])


def upload_bodies(df: DataFrame, scans: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(repo, part, body): the base64 text of each repo's gzipped SARIF document, in parts.

    Each part of the document is a gzip member, and members concatenate to a gzip file. A member's length is a multiple
    of 3 bytes, so each is encoded on its own and the parts of ``body`` concatenate to the encoding of the whole.
    """
    fragments = sarif_document_parts(df, scans)
    members = parts(fragments, chunk).select("repo", "part", "text").mapInArrow(_members, "repo string, part bigint, member binary")
    return members.select("repo", "part", F.translate(F.base64("member"), "\r\n", "").alias("body"))
