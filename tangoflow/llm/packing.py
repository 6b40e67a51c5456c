"""Concatenate-and-cut packing into fixed token windows.

Pass one tokenises every document inside its input partition, appends the
end id and keeps the running offset there (Arrow batches in, Arrow batches
out; written, so the second pass and any retry read the same partitions and
ids).  Prefix sums over the partitions' token totals, one row per partition,
turn local offsets into global ones.  Pass two cuts at multiples of the window
with column expressions only; a document that spans windows gives one piece
in each, and the windows at partition borders join pieces of both.

Cases: null and empty texts are the end id alone; every id lies in exactly
one piece, whatever a text's length; repeated rows and rows with a null id are packed one by one; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tangoflow.llm.common import materialise

WINDOW = 2048
END_ID = 1
ID_BYTES = 4  # of an id in the result; on disk an id of a small vocabulary takes two


@functools.lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer of a ``tokenizers`` file, and a faster encoder of the
    same byte-level vocabulary: merges are in the order of their ids, so the
    byte ranks alone give the same ids (tests compare the two)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = tuple(t["content"] for t in spec.get("added_tokens", []))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return exact, fast, special


def encode(text: str, path: str) -> list[int]:
    exact, fast, special = _encoders(path)
    if any(x in text for x in special):  # an added token's string is that token
        return exact.encode(text, add_special_tokens=False).ids
    try:
        return fast.encode_ordinary(text)
    except BaseException as e:  # noqa: BLE001  the fast encoder's pattern engine gives up on some very long runs
        if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
            raise
        return exact.encode(text, add_special_tokens=False).ids


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Per row: key, part, at (tokens of its partition before it), n and the
    ids as little-endian unsigned integers of ``width`` bytes.  Written."""
    from tokenizers import Tokenizer

    key_type = docs.schema[key].dataType
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else ID_BYTES
    kind = f"<u{width}"

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                ids = [np.array([*encode(t or "", path), end_id], dtype=kind) for t in piece.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(ids), part, dtype=np.int64)), pa.array(start), pa.array(n),
                     pa.array([x.tobytes() for x in ids], pa.binary())], names=["key", "part", "at", "n", "ids"])

    schema = StructType([StructField("key", key_type), StructField("part", LongType()), StructField("at", LongType()),
                         StructField("n", LongType()), StructField("ids", BinaryType())])
    return materialise(docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
                       .mapInArrow(run, schema).withColumn("width", F.lit(width)), "packing-tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``start``: the tokens of all partitions before a row's.
    The totals table has one row per input partition and is written first, so
    Spark knows its size when it picks the join."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")),
                          "packing-offsets")
    return tokens.join(offsets, "part").select("key", "n", "ids", "width", (F.col("offset") + F.col("at")).alias("start"))


def pieces(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per piece: key, its place in the document and in its sequence,
    and its ids."""
    p = placed(tokens)
    c = F.col
    first = F.floor(c("start") / window)
    last = F.floor((c("start") + c("n") - 1) / window)
    held = ("key", "n", "ids", "width")
    cut = p.select(*held, c("start").alias("__start"), F.explode(F.sequence(first, last)).alias("sequence_id"))
    lo = F.greatest(c("__start"), c("sequence_id") * window)
    hi = F.least(c("__start") + c("n"), (c("sequence_id") + 1) * window)
    at = cut.select(*held, "sequence_id", (lo - c("__start")).alias("start"), (hi - lo).alias("length"),
                    (lo - c("sequence_id") * window).alias("offset"))
    own = F.substring("ids", (c("start") * c("width") + 1).cast("int"), (c("length") * c("width")).cast("int"))
    wide = F.when(c("width") == ID_BYTES, own).otherwise(F.unhex(F.regexp_replace(F.hex(own), "(.{4})", "$10000")))
    return at.select("key", "start", "length", F.col("n").alias("doc_tokens"), "sequence_id", "offset", wide.alias("ids"))


def id_crc32(ids: str) -> Column:
    return F.crc32(F.col(ids))


def sequences(cut: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ids in order, the last one padded to
    the window unless its length is a power of two."""
    rows = cut.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"), F.sum("length").alias("length"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    short = (F.col("length") < window) & (F.bit_count(F.col("length")) != 1)
    zeros = F.unhex(F.repeat(F.lit(pad_id.to_bytes(ID_BYTES, "little").hex()), (F.lit(window) - F.col("length")).cast("int")))
    return rows.select("sequence_id", "length", F.when(short, F.concat(joined, zeros)).otherwise(joined).alias("ids"))


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The pieces' digest: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    cut = pieces(tokenised(docs, path, key, text), window)
    return cut.select(F.col("key").alias(key), "start", "length", id_crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")
