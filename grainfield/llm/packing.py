"""Best-fit packing of documents into fixed-length sequences, planned over a histogram of lengths.

Best fit decreasing needs only how many pieces of each length there are. The plan (a few thousand slot ranges at
most, whatever the number of documents) says for each length: ranks a..b of that length go to sequences s.., at
offset o. Pieces then take their slots by their rank within their length, counted by Spark in salted groups.

Nulls and odd cases: a null text counts as empty and has the end token only. A null id is kept, as are repeated
rows, each packed on its own. Ties of a length are ranked in any order, which does not change the number of
sequences. Empty tables give empty results. Very long texts are cut into full pieces; only the first may be
shorter. Columns besides id and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Pieces of a length are dealt to be ranked into so many groups at least, and into as many as keep a group to so many pieces on average.
SALTS, GROUP = 64, 1 << 18
#: White-space characters from which on a run is cut out before the split pattern, which fails on a million of them.
RUN = 100_000
#: Such a run up to its last character if more text follows, all of it at the end. Python alone counts \x1c to \x1f as white space.
_RUN = re.compile(r"(?<![^\S\x1c-\x1f])[^\S\x1c-\x1f]{%d,}(?=[^\S\x1c-\x1f]|\Z)" % (RUN - 1))
_loaded: dict = {}


def _printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {chr(b if b in own else next(other)): b for b in range(256)}


def byte_bpe(path: str):
    """An encoder for a byte-level BPE vocabulary in a ``tokenizers`` JSON file.

    Its ids are those of ``tokenizers.Tokenizer.from_file(path)``; the same merges run in tiktoken here, which takes
    a fifth of the time. Strings of added tokens in a text are ordinary text here; ``token_ids`` gives them their ids.
    """
    if path not in _loaded:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", ())}
        to_byte = _printable_bytes()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        # fixed value: the split pattern of byte-level vocabularies of this kind
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _loaded[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def added_tokens(path: str) -> dict[str, int]:
    """Strings of a ``tokenizers`` JSON file that have ids of their own wherever they stand in a text."""
    if ("added", path) not in _loaded:
        with open(path, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens", ())
        if any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space with them or must be whole words are not supported")
        _loaded["added", path] = {t["content"]: t["id"] for t in tokens}
    return _loaded["added", path]


def token_ids(enc, text: str, added: dict[str, int] | None = None) -> np.ndarray:
    """The ids of an encoder of ``byte_bpe`` for a text with white-space runs of any length, cut at added tokens first."""
    if added and any(t in text for t in added):
        cut = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
        return np.concatenate([np.array([added[x]], np.uint32) if i % 2 else token_ids(enc, x) for i, x in enumerate(cut)])
    if len(text) < RUN:
        return enc.encode_to_numpy(text)
    parts, at = [], 0
    for run in _RUN.finditer(text):
        parts += [enc.encode_to_numpy(text[at : run.start()]), np.array(enc._encode_single_piece(run.group()), np.uint32)]
        at = run.end()
    return np.concatenate([*parts, enc.encode_to_numpy(text[at:])])


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full size but the first, which takes what is over."""
    first = n - (n - 1) // size * size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and the end token, cut to size."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, added = byte_bpe(tokenizer), added_tokens(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            blobs = []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(token_ids(enc, text.as_py() or "", added), end_id).astype("<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), size)):
                    own = ids[start : start + length]
                    out.append((i, k, start, length, zlib.crc32(own.tobytes())))
                    if with_ids:
                        blobs.append(own.astype(np.int32))
            if not out:
                continue
            i, k, start, length, crc = (np.array(x, np.int64) for x in zip(*out, strict=True))
            columns = [batch.column(0).take(pa.array(i)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(blobs, pa.list_(pa.int32()))] if with_ids else []), names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)


def best_fit(counts: dict[int, int], size: int) -> np.ndarray:
    """Slot ranges of best fit decreasing over counts of lengths.

    Rows (length, first rank, sequences, first sequence, offset, pieces in each sequence): the ranks from the first
    on fill the sequences in turn, each with so many pieces side by side from the offset on. Open sequences are
    kept as ranges by free room. Every step uses up a length or a range, so there are few steps, whatever the counts.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free tokens: (first sequence, sequences)
    free = np.zeros(size + 1, bool)
    slots, opened = [], 0

    def close(r: int, first: int, n: int) -> None:
        room[r].append((first, n))
        free[r] = r > 0

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                r = int(fits[0]) + length
                first, n = room[r].pop()
                free[r] = bool(room[r])
            else:
                r, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = r // length
            full, rest = divmod(left, each)
            use = min(n, full)
            if use:
                slots.append((length, rank, use, first, size - r, each))
                rank, left = rank + use * each, left - use * each
                close(r - each * length, first, use)
            if use < n and left:  # fewer pieces are left than one more sequence has room for
                slots.append((length, rank, 1, first + use, size - r, rest))
                rank, left = rank + rest, 0
                close(r - rest * length, first + use, 1)
                use += 1
            if use < n:
                close(r, first + use, n - use)
    return np.array(slots, np.int64).reshape(-1, 6)


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length between 1 and size; cut should be a written table.

    Rows of a length are dealt to groups by ``_pack_row``, a stored number of each row, where there is one (it is left out of the result): equal and
    null ids then make no group of their own. Only the histogram (at most ``size`` rows) and the plan made from it pass through the driver.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(n is None or not 1 <= n <= size for n in counts):
        raise ValueError(f"lengths must be from 1 to {size}")
    salts = max(SALTS, -(-max(counts.values(), default=0) // GROUP))
    of_row = ["_pack_row"] if "_pack_row" in cut.columns else ["doc_id", "piece", "start"]
    salt = F.pmod(F.xxhash64(*of_row), F.lit(salts)).cast("int")
    dealt = cut.withColumn("_pack_salt", salt)
    groups = dealt.groupBy("length", "_pack_salt").agg(F.count("*").alias("_pack_n"))
    before = W.partitionBy("length").orderBy("_pack_salt").rowsBetween(W.unboundedPreceding, -1)
    groups = written(groups.withColumn("_pack_before", F.coalesce(F.sum("_pack_n").over(before), F.lit(0))), "pack-groups")
    slots = best_fit(counts, size)
    own = F.row_number().over(W.partitionBy("length", "_pack_salt").orderBy(*of_row)) - 1
    ranked = dealt.withColumn("_pack_rank", own).join(groups.drop("_pack_n"), ["length", "_pack_salt"])
    ranked = ranked.withColumn("_pack_rank", F.col("_pack_rank") + F.col("_pack_before")).drop("_pack_salt", "_pack_before")
    names = [c for c in ranked.columns if c not in ("_pack_rank", "_pack_row")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, _, firsts, offsets, each = slots.T if len(slots) else np.zeros((6, 1), np.int64)
        top = int(ranks.max(initial=0)) + 1
        order = np.argsort(lengths * top + ranks, kind="stable")
        keys = (lengths * top + ranks)[order]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_pack_rank"))
            # a rank past the last range's first one still belongs to that range
            at = order[np.searchsorted(keys, length * top + np.minimum(rank, top - 1), "right") - 1]
            nth = rank - ranks[at]
            sequence, offset = firsts[at] + nth // each[at], offsets[at] + nth % each[at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*ranked.select(*names).schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, schema).select(*[c for c in cut.columns if c != "_pack_row"], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from packed pieces that carry ids (``pieces(with_ids=True)``)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    cut = pieces(docs, tokenizer or tokenizer_path(), size, end_id).withColumn("_pack_row", F.monotonically_increasing_id())
    return pack(written(cut, "pack-pieces"), size)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
