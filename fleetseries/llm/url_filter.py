"""URL filters: rules first, then a block list kept as a sorted array of digests.

The list is sorted by the 64-bit XXH64 of its entries and written as files of BLOCK_ENTRIES entries at most: digests,
string offsets and strings. Spark sends the files to the executors, where tasks map them into memory (all workers of
a machine share the pages), find candidates by vectorised binary search and compare the whole strings, so that a
collision of digests never blocks anything. A list of any length is that many more files; rows never move.

Entries are `host/` (that host and all its subdomains) or `host/path` (that page alone).

Cases: a null url, or one without `://`, has an empty host and path, fits no rule, and is allowed; an empty list
allows everything; repeated pages each come back; other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseries.llm.common import shared_dir

#: (verdict, host, path prefix); the longest rule that fits wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SEED = 42
BLOCK_ENTRIES = 500_000
#: Host labels of the kinds of sites that the default list blocks (fixed values).
BAD_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    at = F.locate("://", url)
    rest = F.substring_index(F.substring_index(F.substring_index(url.substr(at + 3, F.length(url)), "/", 1), "?", 1), "#", 1)
    ascii_lower = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, ascii_lower).otherwise(F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is none."""
    at = F.locate("://", url)
    rest = F.substring_index(F.substring_index(url.substr(at + 3, F.length(url)), "?", 1), "#", 1)
    slash = F.locate("/", rest)
    return F.when((at > 0) & (slash > 0), rest.substr(slash, F.length(rest))).otherwise(F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def default_list(pages: DataFrame, labels=BAD_LABELS) -> DataFrame:
    """(entry): the domain, from the bad label on, of every page whose host has one."""
    parts = F.split(host(F.col("url")), r"\.")
    at = F.array_position(F.transform(parts, lambda x: x.isin(*labels)), True)
    return pages.where(at > 0).select(F.concat(F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "."), F.lit("/")).alias("entry")).distinct()


def build(entries: DataFrame, block: int = BLOCK_ENTRIES) -> list[str]:
    """Write the index of entries(entry) to the shared folder and hand it to the executors; returns the files' names.

    Spark removes repeats and sorts by digest; the driver streams the sorted rows and holds one block at a time.
    """
    spark = entries.sparkSession
    rows = entries.where("entry is not null").select("entry").distinct().select(F.xxhash64("entry").alias("digest"), "entry")
    signed = rows.withColumn("high", F.shiftrightunsigned("digest", 1))  # unsigned order: by all bits but the last, then the last
    ordered = signed.orderBy("high", F.col("digest").bitwiseAND(F.lit(1)), "entry").select("digest", "entry")
    names: list[str] = []
    held: list = []

    def write() -> None:
        digests = np.array([r[0] for r in held], np.int64).view(np.uint64)
        strings = [r[1].encode() for r in held]
        ends = np.cumsum([len(s) for s in strings], dtype=np.uint64)
        name = f"url-index-{uuid.uuid4().hex}"
        raw = struct.pack("<Q", len(held)) + digests.tobytes() + ends.tobytes() + b"".join(strings)
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fleetseries/{name}")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        for at in range(0, len(raw), 1 << 24):
            out.write(bytearray(raw[at : at + (1 << 24)]))
        out.close()
        spark.sparkContext.addFile(str(place.toString()))
        names.append(name)
        held.clear()

    for row in ordered.toLocalIterator():
        held.append(row)
        if len(held) == block:
            write()
    if held:
        write()
    return names


class DigestArray:
    """One index file, mapped into memory."""

    def __init__(self, file: str):
        n = struct.unpack("<Q", open(file, "rb").read(8))[0]
        self.digests = np.memmap(file, "<u8", "r", 8, n)
        self.ends = np.memmap(file, "<u8", "r", 8 + 8 * n, n)
        self.text = np.memmap(file, np.uint8, "r", 8 + 16 * n, int(self.ends[-1]))

    def holds(self, digests: np.ndarray, strings: list[bytes]) -> np.ndarray:
        """Which of the strings (with these digests) are entries: binary search, then the whole string of every equal digest."""
        low, high = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        out = np.zeros(len(strings), bool)
        for k in np.flatnonzero(high > low):
            for at in range(low[k], high[k]):
                start = int(self.ends[at - 1]) if at else 0
                if self.text[start : int(self.ends[at])].tobytes() == strings[k]:
                    out[k] = True
        return out


@lru_cache(maxsize=64)
def opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def candidates(host_: str, path_: str) -> list[str]:
    """The entries that would block this page: each suffix of its host, and the page itself."""
    if not host_:
        return []
    parts = host_.split(".")
    return [".".join(parts[k:]) + "/" for k in range(len(parts))] + ([host_ + path_] if path_ not in ("", "/") else [])


def blocked(pages: DataFrame, names: list[str]) -> DataFrame:
    """pages (with host and path) with `listed`: whether the index holds one of the page's candidates."""
    schema = T.StructType([*pages.schema.fields, T.StructField("listed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [candidates(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            strings = [s.encode() for c in own for s in c]
            row = np.repeat(np.arange(len(own)), [len(c) for c in own])
            digests = np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], np.uint64)
            hit = np.zeros(len(strings), bool)
            for name in names:
                hit |= opened(name).holds(digests, strings)
            listed = np.zeros(len(own), bool)
            listed[row[hit]] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed)], names=[*batch.schema.names, "listed"])

    return pages.mapInArrow(run, schema)


def judge(pages: DataFrame, entries: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page: its longest rule's, else block if the list holds it."""
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    looked = blocked(split, build(entries))
    own = rule(F.col("host"), F.col("path"), rules)
    return looked.select(
        "page_id", "host", "path", own["rule"].alias("rule"),
        F.coalesce(own["verdict"], F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )
