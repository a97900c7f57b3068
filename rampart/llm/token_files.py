"""Token-ID files: ORC stripes with integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_automaton import vocabulary
from .common import stored, stored_path
from .pieces import PieceIds, slices, word_pieces

#: One row a document; ``part`` and ``start_in_part`` place it: the ids of its part's earlier documents.
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"
WRITER = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.encoding.strategy": "COMPRESSION",
    "compression": "zstd",
}


#: Pieces that one call of the library gets, and bytes of pieces that a worker keeps (twice).
CALL, KEPT = 1000, 96 << 20
#: What pieces cut by their bytes consist of (``pieces.word_pieces``); odd words hold something else.
PLAIN = regex.compile(r"[\x00-\x7f\xa1-\xff\u2010-\u2027]*")
#: The kind of tokenizer that this encoder cuts texts for (fixed values of its file).
PATTERN, NORMALIZERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", ["NFC", "Replace", "Lowercase"]


class WordEncoder:
    """Ids by the tokenizers library, each different piece once.

    The tokenizer drops white space and splits at it, its normalizer works on characters, and its special
    tokens hold no white space, so a text's ids are those of its words in order. Words are cut into the
    pieces that its pre-splitter would make, in lower case; those not seen before go to the library's model
    in calls of CALL. A word with a character beyond the tables, or maybe a special token, goes through the
    whole tokenizer as it is.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        told = json.loads(spec)
        if told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN or [x["type"] for x in told["normalizer"]["normalizers"]] != NORMALIZERS:
            raise ValueError("not a tokenizer of the kind with word ends")
        self.tokenizer, self.model = Tokenizer.from_str(spec), Tokenizer.from_str(spec)
        for t in (self.tokenizer, self.model):
            t.no_truncation()
            t.no_padding()
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [x["content"] for x in told["added_tokens"]]
        self.pieces = PieceIds(word_pieces, self._encode, self.special, KEPT)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if "<|" not in p and (p.isascii() or PLAIN.fullmatch(p))]
        calls = [plain[k : k + CALL] for k in range(0, len(plain), CALL)]
        for call, found in zip(calls, self.model.encode_batch([" ".join([pieces[k] for k in c]) for c in calls], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int32).tobytes()
            ends = (np.cumsum(np.bincount(found.word_ids, minlength=len(call))) * 4).tolist()
            for k, a, b in zip(call, [0, *ends], ends, strict=False):
                out[k] = ids[a:b]
        odd = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(odd, self.tokenizer.encode_batch_fast([pieces[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = np.array(found.ids, np.int32).tobytes()
        return out


#: The encoder of this worker process, which tasks use one after the other, by its tokenizer.
_KEPT: dict[int, WordEncoder] = {}


def _encoder(shared, key: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are shared out by tasks
        part, start = TaskContext.get().partitionId(), 0
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = WordEncoder(shared.value)
        for batch in batches:
            for piece in slices(batch):
                ids, ends = _KEPT[key].pieces.texts(piece.column("text"))
                n = piece.num_rows
                ids = np.insert(ids, ends, end_id).astype(np.int32)
                ends = ends + np.arange(1, n + 1)
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(start + starts), pa.array((ends - starts).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Writes the ids of every document, ``end_id`` appended, as ORC files in ascending order of doc_id.

    docs: doc_id, text. ``tokenizer`` is a JSON file of the tokenizers library, read by the driver. Null
    ids come first, null and empty texts have just the end id; rows of one id are ordered by their text's
    hash, and even one id with most of the rows is ranged over many files. Very long texts are encoded whole,
    in slices of their own; further columns, whatever their names, are ignored; an empty table gives files
    without rows. Ranges of documents are shuffled
    before they are encoded, so the sampling of ranges doesn't encode.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    key = ["doc_id", "_text", "_row"]
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    ranged = told.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    ranged.mapInArrow(_encoder(shared, zlib.crc32(spec.encode()), end_id), SCHEMA).write.options(**WRITER).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; a filter on doc_id reaches the stripes' statistics, row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "start_in_part")), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; one row of sums a file is windowed."""
    rows = read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(sums.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")), "parts")
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and returns what the files hold."""
    path = stored_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), path)
    return token_index(spark, path)
