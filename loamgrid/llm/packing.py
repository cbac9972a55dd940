"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Each document's ids are followed by one end id. Whole blocks of ``size`` ids become pieces of their own; the
remainder is one piece more. Documents go to groups at random (by hash, ``group_docs`` on average, whatever
the number of documents), and each group packs its pieces alone: longest first, into the leftmost bin with
room, found in a tournament tree of the free room in log time. Bins that are left with room are closed up by
cutting: the ids of the emptiest bins fill the room of the others, so that in a group at most a few ids are
padding. As ids may be cut anywhere only before checksums are made, each document's ids travel with its
remainder (fewer than ``size`` ids), never with its full blocks.

Ids come from a file of the ``tokenizers`` library; its path is a parameter.

Cases: null and empty texts have only the end id; repeated rows are packed as often as they occur; an empty
table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 1024
GROUP_DOCS = 4096
#: Fixed: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken's search for words overflows its stack on a run of white space of 1,000,000 characters (300,000 pass here).
RUN = 50_000
_RUN = re.compile(rf"(?<!\s)\s{{{RUN}}}")
PROBES = ["It's  a\n\n test, isn't it?\t12 345.67 <|end of text|>", " na\u00efve \u4e2d\u6587\u3000x \U0001f600\u00a0 y\r\n", "", " ", "  \n x", "\u0130\u0660\u2160\u0301a"]
_loaded: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The file's byte-pair merges run through ``tiktoken``, four times as fast, where a probe shows that both
    libraries agree on the file; else ``tokenizers`` itself encodes, as it does texts that hold an added token (one
    id of its own) or white space of ``RUN`` characters. Tests hold whole tables against it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self._merges()

    def _merges(self):
        try:
            import tiktoken
            from tokenizers.pre_tokenizers import ByteLevel

            # ByteLevel writes each byte as one printable character: those of Latin-1 as they are, the others from U+0100 on in order
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
            if sorted(byte) != sorted(ByteLevel.alphabet()):
                return None
            ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in self.added}
            made = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            agreed = all(made.encode_ordinary(t) == self.tokenizer.encode(t, add_special_tokens=False).ids for t in PROBES)
            return made if agreed else None
        except (ImportError, KeyError, ValueError):
            return None

    def plain(self, text: str) -> bool:
        """No added token and no very long white space: both libraries give the same ids."""
        return not any(t in text for t in self.added) and (len(text) < RUN or not _RUN.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.merges:
            fast, whole = self.merges.encode_ordinary, self.tokenizer.encode
            return [array("I", fast(t) if self.plain(t) else whole(t, add_special_tokens=False).ids).tobytes() for t in texts]
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Tournament:
    """Free room of bins; each inner node holds the most room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """The leftmost bin with room for length; takes the room."""
        room, i = self.room, 1
        if room[1] < length:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i = 2 * i if room[2 * i] >= length else 2 * i + 1
        room[i] -= length
        bin_ = i - self.leaves
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return bin_


def first_fit_decreasing(lengths: list[int], size: int = SIZE) -> list[int]:
    """The bin of each length; longest first, ties in the given order."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree, out = Tournament(len(lengths), size), [0] * len(lengths)
    for i in order:
        out[i] = tree.place(lengths[i])
    return out


def close_up(lengths: list[int], bins: list[int], size: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, from, length): the emptiest bins are taken apart to fill the others' room, the last rest goes to powers of two."""
    held: dict[int, list[tuple[int, int, int]]] = {}
    for i, b in enumerate(bins):
        held.setdefault(b, []).append((i, 0, lengths[i]))
    full = sorted(held.values(), key=lambda x: -sum(p[2] for p in x))
    load = [sum(p[2] for p in x) for x in full]
    left, right = 0, len(full) - 1
    while left < right:
        room = size - load[left]
        if not room:
            left += 1
            continue
        item, start, n = full[right].pop()
        take = min(room, n)
        full[left].append((item, start, take))
        load[left] += take
        load[right] -= take
        if n > take:
            full[right].append((item, start + take, n - take))
        if not full[right]:
            right -= 1
    out = full[:right]
    if full:
        last, rest = full[right], load[right]
        if rest == size:
            out.append(last)
        else:
            for power in (1 << k for k in range(size.bit_length() - 1, -1, -1)):
                if rest & power:
                    part, need = [], power
                    while need:
                        item, start, n = last.pop(0)
                        take = min(need, n)
                        part.append((item, start, take))
                        if n > take:
                            last.insert(0, (item, start + take, n - take))
                        need -= take
                    out.append(part)
    return out


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PACKED = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, group_docs: int = GROUP_DOCS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as bytes on demand)."""
    groups = max(1, -(-docs.count() // group_docs))
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * size

    def cut(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(all_ids):
                texts, held, a = [], 0, at
                while at < len(all_ids) and held < 2_000_000:
                    texts.append(all_texts[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                rows = []
                for doc, ids in zip(all_ids[a:at], enc.encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, size):
                        own = ids[4 * s : 4 * s + step]
                        rows.append((doc, s, len(own) // 4, zlib.crc32(own), n, own if len(own) < step or with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    # all pieces of a document go to one group; rows that share an id are told apart by their checksums
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.when(F.col("length") < size, F.col("ids_crc32")), F.when(F.col("length") == size, F.col("start"))), F.lit(groups)).cast("long"))
    out = pa.schema([*PACKED, *([("ids", pa.binary())] if with_ids else [])])

    def one(key, table):
        g = key[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        cols = {n: table.column(n).to_pylist() for n in table.column_names}
        length = cols["length"]
        rows, seq = [], 0
        part = [i for i, n in enumerate(length) if n < size]
        for i in (i for i, n in enumerate(length) if n == size):
            rows.append((cols["doc_id"][i], cols["start"][i], size, cols["ids_crc32"][i], cols["doc_tokens"][i], g << 32 | seq, 0, cols["ids"][i]))
            seq += 1
        lengths = [length[i] for i in part]
        for bin_ in close_up(lengths, first_fit_decreasing(lengths, size), size):
            offset = 0
            for k, start, n in sorted(bin_):
                i = part[k]
                ids = cols["ids"][i][4 * start : 4 * (start + n)]
                rows.append((cols["doc_id"][i], cols["start"][i] + start, n, zlib.crc32(ids), cols["doc_tokens"][i], g << 32 | seq, offset, ids))
                offset += n
            seq += 1
        columns = list(zip(*rows, strict=True))[: len(out)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return pieces.groupBy("grp").applyInArrow(one, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
