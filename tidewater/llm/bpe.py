"""BPE encoding and decoding through a table of distinct words.

Words (what white space separates, normalised) are split in Spark tasks and
counted; each distinct word that occurs more than once is encoded once into a
table (word, ids) whose size is bounded by ``MAX_TABLE_WORDS``, most frequent
first; ids join back by the word's position. A word outside the table (a word
that occurs once, a very long one, or the tail of a vocabulary over the bound) is
encoded where it stands, so no text is shortened and results do not depend on the
bound. Decoding joins ids with the id-to-piece table, whose size is the
tokenizer's vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize

#: Bound of the broadcast table.
MAX_TABLE_WORDS = 300_000
_FLUSH = 200_000
#: Longer words are never in the table, which bounds its bytes.
MAX_WORD_CHARS = 64

#: White space of the tokenizer's normaliser (Unicode White_Space).
_SPACE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


_NOT_SPACE, _CONTROL = re.compile(f"[^{_SPACE}]+"), re.compile("[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordSplitter:
    """Special tokens and words of a text, as the tokenizer's normaliser and pre-tokenizer cut it.

    It takes tokenizers whose normaliser is NFC, space folding and lower case and
    whose pre-tokenizer is one regular expression; others are refused.
    """

    def __init__(self, config: str):
        j = json.loads(config)
        steps = [x["type"] for x in j["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"normaliser {steps} is not supported")
        split = j["pre_tokenizer"]["pretokenizers"][0]
        pattern = split["pattern"]["Regex"]
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pieces = regex.compile(pattern.replace("\\s", _SPACE), regex.V0)

    def pieces(self, word: str) -> list[str]:
        """The pre-tokenizer's pieces of a word."""
        return self._pieces.findall(word)

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # split() also cuts at four control characters that the tokenizer doesn't count as space
        return _NOT_SPACE.findall(text) if _CONTROL.search(text) else text.split()

    def parts(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """Runs of words (False) and special tokens (True), in order."""
        if self._special is None or "<|" not in text and not self._special.search(text):
            yield False, self.words(text)
            return
        for i, part in enumerate(self._special.split(text)):
            if i % 2:
                yield True, [part]
            elif part:
                yield False, self.words(part)


class WordEncoder:
    """Ids of single normalised words, straight from the BPE model."""

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        if json.loads(config)["model"]["type"] != "BPE":
            raise ValueError("only BPE models are supported")
        self.splitter, self.model = WordSplitter(config), Tokenizer.from_str(config).model
        # byte-level alphabet: printable bytes stand for themselves, the others for what follows U+0100
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __call__(self, word: str) -> list[int]:
        tokenize, alphabet = self.model.tokenize, self.alphabet
        return [t.id for p in self.splitter.pieces(word) for t in tokenize(p.encode().decode("latin1").translate(alphabet))]


def _config(path: str | None) -> str:
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        return f.read()


def word_counts(docs: DataFrame, config, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; tasks pre-aggregate before the shuffle."""

    def run(batches):
        splitter, counts = WordSplitter(config.value), Counter()

        def rows():
            for word in [w for w in counts if len(w) > MAX_WORD_CHARS]:
                del counts[word]
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for special, words in splitter.parts(text):
                        if not special:
                            counts.update(words)
                if len(counts) > _FLUSH:
                    yield rows()
                    counts.clear()
        yield rows()

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, config, text_col: str = "text", max_words: int = MAX_TABLE_WORDS) -> dict[str, str]:
    """Ids (decimal, joined by a space) of the distinct words that repeat, at most ``max_words``, each encoded once in a task."""
    counts = materialize(word_counts(docs, config, text_col).where("n > 1"), "words")
    by_count = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().orderBy(F.desc("n")).toLocalIterator()
    least, total = 1 << 62, 0
    for r in by_count:
        total += r["count"]
        if total > max_words:
            break
        least = r["n"]

    def run(batches):
        encode_word = WordEncoder(config.value)
        for batch in batches:
            ids = [" ".join(map(str, encode_word(w))) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.string())], names=["word", "ids"])

    table = counts.where(F.col("n") >= F.lit(least)).select("word").mapInArrow(run, "word string, ids string")
    return {r.word: r.ids for r in table.toLocalIterator(prefetchPartitions=False)}


_FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]
#: Words outside the table that a task remembers.
_REMEMBERED = 50_000


class _Ids(dict):
    """Word to ids: the table, and the encoder for what it lacks."""

    def __init__(self, table: dict[str, str], config: str):
        super().__init__(table)
        self.encode, self.room = WordEncoder(config), len(table) + _REMEMBERED

    def __missing__(self, word: str) -> str:
        ids = " ".join(map(str, self.encode(word)))
        if len(self) < self.room and len(word) <= MAX_WORD_CHARS:
            self[word] = ids
        return ids


class _Decoded(dict):
    """Ids of a word to its pieces, through the id-to-piece table."""

    def __init__(self, config: str):
        self.piece = {str(i): p for i, p in _pieces(config).items()}

    def __missing__(self, ids: str) -> str:
        text = " ".join(map(self.piece.__getitem__, ids.split(" ")))
        if len(self) < MAX_TABLE_WORDS and len(ids) <= 4 * MAX_WORD_CHARS:
            self[ids] = text
        return text


class _Encoder:
    """Positions to ids in one task."""

    def __init__(self, config: str, table: dict[str, str]):
        self.splitter, self.ids = WordSplitter(config), _Ids(table, config)

    def encode(self, text: str | None) -> list[str]:
        """Ids of each word and special token, by position."""
        out: list[str] = []
        for special, words in self.splitter.parts(text or ""):
            if special:
                out.append(str(self.splitter.special[words[0]]))
            else:
                out += map(self.ids.__getitem__, words)
        return out


def encode(docs: DataFrame, *, tokenizer: str | None = None, text_col: str = "text", max_words: int = MAX_TABLE_WORDS) -> DataFrame:
    """``docs`` with ``ids`` array<int>, the tokenizer's encoding without added special tokens.

    Null is encoded like the empty text, to no ids. A column ``ids`` is replaced;
    repeated rows are encoded alike.
    """
    sc = docs.sparkSession.sparkContext
    config = sc.broadcast(_config(tokenizer))
    table = sc.broadcast(word_table(docs, config, text_col, max_words))

    def make():
        encoder = _Encoder(config.value, table.value)

        def work(texts):
            return [pa.array([[int(i) for w in encoder.encode(t) for i in w.split(" ")] for t in texts.to_pylist()], pa.list_(pa.int32()))]

        return work

    return append_columns(docs, [text_col], [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode(docs: DataFrame, *, tokenizer: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``: pieces of the ids joined by a space (this tokenizer has no decoder); null ids decode to the empty text."""
    config = docs.sparkSession.sparkContext.broadcast(_config(tokenizer))

    def make():
        piece = _pieces(config.value)

        def work(ids):
            return [pa.array([" ".join(map(piece.__getitem__, x or [])) for x in ids.to_pylist()], pa.string())]

        return work

    return append_columns(docs, [ids_col], [T.StructField("decoded", T.StringType())], make)


def _pieces(config: str) -> dict[int, str]:
    """The id-to-piece table; its size is the vocabulary's."""
    j = json.loads(config)
    if j.get("decoder") is not None:
        raise ValueError("only tokenizers without a decoder are supported")
    return {i: piece for piece, i in j["model"]["vocab"].items()} | {x["id"]: x["content"] for x in j["added_tokens"]}


def digests(docs: DataFrame, *, tokenizer: str | None = None, text_col: str = "text", max_words: int = MAX_TABLE_WORDS) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of whole texts.

    Null counts as the empty text, which has no tokens and the digests of empty strings; texts of any length are
    encoded whole; repeated rows get equal results; columns of the new names are replaced, all others pass through;
    an empty table gives an empty one. Words outside the table of at most ``max_words`` are encoded where they stand.
    """
    sc = docs.sparkSession.sparkContext
    config = sc.broadcast(_config(tokenizer))
    table = sc.broadcast(word_table(docs, config, text_col, max_words))

    def make():
        encoder, decoded = _Encoder(config.value, table.value), _Decoded(config.value)
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

        def work(texts):
            n, by_ids, by_text = [], [], []
            for text in texts:
                words = encoder.encode(text.as_py())
                ids = " ".join(words)
                n.append(ids.count(" ") + 1 if ids else 0)
                by_ids.append(digest(ids))
                by_text.append(digest(" ".join(map(decoded.__getitem__, words))))
            return [pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())]

        return work

    return append_columns(docs, [text_col], _FIELDS, make)
