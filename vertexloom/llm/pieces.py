"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked as SentencePiece does (a leading mark, blanks become marks) and cut before every run
of marks, between letters and signs, and around line ends; no piece of the vocabulary reaches over
such a cut (checked when it is loaded), so words are encoded one by one.  The distinct words of a batch are sorted, which is the depth-first order of their trie: what a word has in
common with the one before it keeps its forward scores, and only the rest of the word is searched.

The public model at hand holds merge ranks, not log-probabilities: its "scores" are minus the rank.
Forward scores therefore use the Zipf law that the ranks stand for, log p = -log(rank + 1) - log H.
The segmentation is the best one under that law; it isn't the merge order of the library's BPE
(README has the agreement).  A character outside the vocabulary becomes its UTF-8 byte pieces.

A null text gives null pieces, an empty one no pieces.  Decoding gives back the text exactly, except
that a literal mark U+2581 becomes a blank, as in the library.  Whole texts of any length are taken: the
search holds one word's scores at a time.  Extra columns are kept.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vertexloom.llm.base import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Word characters that some piece joins to a sign count as signs.
JOINED = re.compile(r"([^\W_])[\W_]|[\W_]([^\W_])")
#: Words whose pieces a worker remembers, and their characters in all; then it starts anew.
REMEMBERED, REMEMBERED_CHARACTERS = 120_000, 10_000_000


class Vocabulary:
    """Pieces with ids and log-probabilities of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        harmonic = math.log(sum(1 / r for r in range(1, size + 1)))
        self.table: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.table[piece] = (i, -math.log(i + 1) - harmonic)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.table))
        self.byte_score = -math.log(size + 1) - harmonic
        #: Every ending of a piece; those that are pieces themselves have an id and a score.
        self.endings: dict[str, tuple] = {p[i:]: () for p in self.table for i in range(1, len(p))} | self.table
        odd = re.escape("".join(sorted({x or y for p in self.table for x, y in JOINED.findall(p.lstrip(MARK))})))
        self.words = re.compile(f"\n|{MARK}*(?:[^\\W_{odd}]+|(?:[^\\w{MARK}\n]|[_{odd}])+)|{MARK}+")
        if not all(map(self.words.fullmatch, self.table)):
            raise ValueError(f"{path}: a piece reaches over a word's end")

    def cut(self, text: str | None) -> list[str]:
        """The marked words of a text."""
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file; where this machine has no such path, of the file of that name that was sent with ``addFile``."""
    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    return Vocabulary(os.path.realpath(path))


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def encode_words(words: list[str], vocab: Vocabulary) -> Iterator[tuple[str, list[int]]]:
    """The best segmentation of each of the sorted, distinct ``words``.

    ``score[j]`` is the best log-probability of the first j characters, ``back[j]`` the start of its
    last piece; both are kept over the prefix that a word shares with its predecessor.
    """
    table, ending = vocab.table, vocab.endings.get
    score, back, before = [0.0], [0], ""
    for word in words:
        shared = common_prefix(before, word)
        del score[shared + 1 :], back[shared + 1 :]
        for j in range(shared + 1, len(word) + 1):
            best, at = -math.inf, j - 1
            for i in range(j - 1, -1, -1):
                piece = ending(word[i:j])
                if piece is None:
                    break
                if piece and score[i] + piece[1] >= best:
                    best, at = score[i] + piece[1], i
            if best == -math.inf or word[j - 1] not in table and score[j - 1] + vocab.byte_score * len(word[j - 1].encode()) > best:
                best, at = score[j - 1] + vocab.byte_score * len(word[j - 1].encode()), j - 1
            score.append(best)
            back.append(at)
        ids, j = [], len(word)
        while j:
            piece = table.get(word[back[j] : j])
            ids += [piece[0]] if piece else [vocab.byte_ids[b] for b in reversed(word[back[j] : j].encode())]
            j = back[j]
        yield word, ids[::-1]
        before = word


class Encoder:
    """Encodes batches of texts and remembers the pieces of words it has seen."""

    def __init__(self, path: str = MODEL) -> None:
        self.vocab, self.known, self.size = vocabulary(path), {}, 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's piece ids as the bytes of 32-bit integers."""
        cut = list(map(self.vocab.cut, texts))
        if len(self.known) > REMEMBERED or self.size > REMEMBERED_CHARACTERS:
            self.known.clear()
            self.size = 0
        new = sorted({w for words in cut for w in words}.difference(self.known))
        self.size += sum(map(len, new))
        for word, ids in encode_words(new, self.vocab):
            self.known[word] = np.array(ids, dtype=np.int32).tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The text of piece ids; raises for an id outside the vocabulary."""
    raw = b"".join(map(vocab.bytes_of.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _appended(df: DataFrame, names: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(k, v) for k, v in names.items()])


def _with(batch: pa.RecordBatch, schema: T.StructType, new: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = [new[f.name] if f.name in new else batch.column(f.name) for f in schema.fields]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def encode(df: DataFrame, text: str = "text", into: str = "pieces", path: str = MODEL, check: str | None = None) -> DataFrame:
    """``df`` with ``into``, an array of piece ids of ``text``; a column of that name is replaced.

    ``check`` names a boolean column that says whether the ids decode to the text again (null: true).
    """
    schema = _appended(df, {into: T.ArrayType(T.IntegerType())} | ({check: T.BooleanType()} if check else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches, 500):
            texts = batch.column(text).to_pylist()
            coded = encoder(texts)
            ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(coded), dtype=np.int32))
            nulls = np.array([t is None for t in texts] + [False])
            new = {into: pa.ListArray.from_arrays(pa.array(ends, mask=nulls), values)}
            if check:
                back = (decode(np.frombuffer(c, dtype=np.int32).tolist(), encoder.vocab) for c in coded)
                new[check] = pa.array([(t or "").replace(MARK, " ") == b for t, b in zip(texts, back, strict=True)])
            yield _with(batch, schema, new)

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, pieces: str = "pieces", into: str = "decoded", path: str = MODEL) -> DataFrame:
    """``df`` with ``into``, the text of the ids in ``pieces``; a column of that name is replaced."""
    schema = _appended(df, {into: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in slices(batches, 1000):
            column = batch.column(pieces)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            out = [decode(values[a:b].tolist(), vocab) if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist())]  # noqa: B905
            yield _with(batch, schema, {into: pa.array(out, pa.string())})

    return df.mapInArrow(run, schema)
