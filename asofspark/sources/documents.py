"""Large JSON documents read member by member.

A document is cut at closing braces into short rows, which reach one task in their order; a tokenizer there
keeps the keys on the way to where it is, and gives each member that is asked for as a row of its own.  So no row
holds a document, and memory holds one member, whatever the document's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+)', re.DOTALL)
_END = "}"


class MemberReader:
    """Takes a document's text piece by piece and gives (pattern number, keys, JSON text) of the members that match a pattern.

    A pattern is a tuple of keys; ``*`` stands for any key of an object and any place of an array (keys has its number).
    """

    def __init__(self, patterns: list[tuple[str, ...]]):
        self.patterns, self.rest = patterns, ""
        self.stack: list[list] = []  # of open objects and arrays: [is an object, key or place, waits for a key]
        self.taken: list[str] | None = None
        self.which, self.depth = -1, 0

    def _match(self) -> int:
        path = [frame[1] for frame in self.stack]
        for n, pattern in enumerate(self.patterns):
            if len(pattern) == len(path) and all(p in ("*", k) for p, k in zip(pattern, path, strict=True)):
                return n
        return -1

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[int, list[str], str]]:
        text, at = self.rest + piece, 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                break
            token = m.group(1)
            if m.end() == len(text) and not last and token[0] not in '{}[]:,"':  # a number may go on in the next piece
                break
            at = m.end()
            yield from self._step(token)
        self.rest = text[at:]
        if last and self.rest.strip():
            raise ValueError("the document ends within a value")

    def _step(self, token: str) -> Iterator[tuple[int, list[str], str]]:
        top = self.stack[-1] if self.stack else None
        if token == ":":
            if self.taken is not None:
                self.taken.append(token)
            return
        if token == ",":
            if self.taken is not None and self.depth:
                self.taken.append(token)
            if top[0]:
                top[2] = True
            else:
                top[1] = str(int(top[1]) + 1)
            return
        if token in "}]":
            self.stack.pop()
            if self.taken is not None:
                self.taken.append(token)
                self.depth -= 1
                yield from self._finish()
            return
        if top is not None and top[0] and top[2]:  # a key
            top[1], top[2] = _text(token), False
            if self.taken is not None:
                self.taken.append(token)
            return
        if self.taken is None and (n := self._match()) >= 0:
            self.taken, self.which, self.depth = [], n, 0
        if self.taken is not None:
            self.taken.append(token)
        if token in "{[":
            self.stack.append([token == "{", "0" if token == "[" else "", token == "{"])
            if self.taken is not None:
                self.depth += 1
        elif self.taken is not None:
            yield from self._finish()

    def _finish(self) -> Iterator[tuple[int, list[str], str]]:
        if self.depth == 0:
            value, self.taken = "".join(self.taken), None
            yield self.which, [frame[1] for frame in self.stack], value


def _text(token: str) -> str:
    if "\\" not in token:
        return token[1:-1]
    simple = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    out = re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else simple.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_members(spark: SparkSession, path: str, patterns: list[tuple[str, ...]]) -> DataFrame:
    """file, pattern, keys, value of every member of the documents under ``path`` (one a file) that matches a pattern.

    ``pattern`` is the pattern's number, keys are the names and array places on the way, value is JSON text.  An empty file
    gives nothing; a document that breaks off raises an error when it is read.
    """
    pieces = spark.read.text(path, lineSep=_END)
    placed = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value")
    ordered = placed.repartition("file").sortWithinPartitions("file", "_block", "_row").select("file", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader, held = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != current:
                    if reader is not None:
                        out.extend((current, *found) for found in reader.feed(held, last=True))
                    current, reader, held = file, MemberReader(patterns), None
                if held is not None:  # every piece but a file's last is followed by the brace that it was cut at
                    out.extend((file, *found) for found in reader.feed(held + _END))
                held = value
            if out:
                yield _batch(out)
        if reader is not None and (out := [(current, *found) for found in reader.feed(_closed(reader, held), last=True)]):
            yield _batch(out)

    return ordered.mapInArrow(run, "file string, pattern int, keys array<string>, value string")


def _closed(reader: MemberReader, held: str) -> str:
    """The last piece; a document's own last brace is cut off with nothing after it."""
    return held + _END if reader.stack else held


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    types = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["file", "pattern", "keys", "value"])


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Filing documents, one company a file, as the rows of filings.read_facts()."""
    row = "struct<start:string,end:string,filed:string,val:double,form:string,fp:string>"
    found = json_members(spark, path, [("cik",), ("facts", "us-gaap", "*", "units", "*", "*")])
    names = found.where("pattern = 0").select("file", F.regexp_replace("value", '^"|"$', "").alias("cik"))
    each = found.where("pattern = 1").select("file", F.col("keys")[2].alias("tag"), F.col("keys")[4].alias("unit"), F.col("keys")[5].cast("int").alias("arr_pos"), F.from_json("value", row).alias("r"))
    day = lambda c: F.try_to_date(f"r.{c}").alias(c)
    return each.join(names, "file", "left").select("cik", "tag", "unit", "arr_pos", day("start"), day("end"), day("filed"), "r.val", "r.form", "r.fp")


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """{key: {ticker, cik_str}} of any size as ticker (upper case) and cik (10 digits)."""
    rows = json_members(spark, path, [("*",)]).select(F.from_json("value", "struct<ticker:string,cik_str:bigint>").alias("r"))
    return rows.select(F.upper("r.ticker").alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"))


def read_sic_map(spark: SparkSession, path: str) -> DataFrame:
    """{cik: code} of any size as cik and a four-digit sic, empty if unknown (null or empty)."""
    code: Column = F.regexp_replace("value", '^"|"$', "")
    rows = json_members(spark, path, [("*",)]).select(F.lpad(F.col("keys")[0], 10, "0").alias("cik"), F.when(F.col("value") != "null", code).alias("c"))
    return rows.select("cik", F.when(F.coalesce("c", F.lit("")) == "", "").otherwise(F.lpad("c", 4, "0")).alias("sic"))
