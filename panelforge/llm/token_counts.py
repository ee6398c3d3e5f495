"""Exact token counts of whole texts, and of every prefix, without re-encoding.

A text is normalised and cut into words as its tokenizer's file says (NFC, white space, lower case; letters, single
digits, other signs, English clitics; bytes as symbols; a marker at word ends), with the library's own tables of cases
and classes, as Unicode versions differ in them.  A prefix program (bpe.py) then gives
the exact count of each prefix of each word, and so of the text: questions of truncation and budget are look-ups.
Counts of words are kept per worker in a bounded table.

Defined cases: null and empty texts have no bytes and no tokens.  Strings of special tokens inside a text count as
one token each, as the library has it.  Rows are independent: null ids, repeats and extra columns do not matter.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger, PrefixProgram

LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Texts of ASCII and Latin-1 letters alone, whose classes and cases no Unicode version changed.
PLAIN_TEXT = r"[\x00-\x1b\x20-\x7e\xa1\xa7\xa9\xab\xae\xb7\xbb\xbf-\xff]*"
#: Fixed value: the word pattern of the tokenizer's file, over plain texts; other texts are matched by stand-ins of their characters.
PLAIN_WORDS = r"'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+"
#: Stand-ins: a letter that begins no clitic, a digit, a sign, white space.
LETTER, NUMBER, SIGN, SPACE = "a", "1", "!", " "
KEPT_WORDS = 1_000_000


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD):
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class StandIns(dict):
    """A stand-in of the same class for each code point beyond ASCII, as the library's own word pattern sees it; for str.translate."""

    def __init__(self, library):
        super().__init__({i: chr(i) for i in range(128)})
        self.split = library.pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> str:
        cuts = [span for _, span in self.split("a" + chr(code) + ".")]
        got = {((0, 2), (2, 3)): LETTER, ((0, 1), (1, 2), (2, 3)): NUMBER, ((0, 1), (1, 3)): SIGN, ((0, 1), (2, 3)): SPACE}[tuple(cuts)]
        self[code] = got
        return got


class Counter(dict):
    """Counts of words, found by the prefix program when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.stand_ins = StandIns(library)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        vocab = model["vocab"]
        inner = {k: v for k, v in vocab.items() if not (end and k.endswith(end))}
        final = {k: v for k, v in vocab.items() if end and k.endswith(end)} if end else None
        self.program = PrefixProgram(inner, Merger(lambda a, b: ranks.get((a, b))), end, final)
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        self.plain, self.plain_words = re.compile(PLAIN_TEXT), re.compile(PLAIN_WORDS)
        self.symbols = byte_symbols()

    def mapped(self, word: str) -> str:
        s = self.symbols
        return "".join([s[b] for b in word.encode()])

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        n = self.program.count(self.mapped(word))
        if len(word) < 64:
            self[word] = n
        return n

    def normal(self, text: str) -> str:
        """NFC, white space as spaces, lower case: by the library's own tables where the text is not plain."""
        return text.lower() if self.plain.fullmatch(text) else self.normalize(text)

    def words(self, text: str) -> list[str]:
        """The words of a normal text."""
        if self.plain.fullmatch(text):
            return self.plain_words.findall(text)
        return [text[m.start() : m.end()] for m in self.plain_words.finditer(text.translate(self.stand_ins))]

    def parts(self, text: str):
        """(normal text, number of special tokens after it)."""
        if self.specials is None or "<|" not in text:
            yield self.normal(text), 0
            return
        at = 0
        for m in self.specials.finditer(text):
            yield self.normal(text[at : m.start()]), 1
            at = m.end()
        yield self.normal(text[at:]), 0

    def count(self, text: str | None) -> int:
        return sum(sum(map(self.__getitem__, self.words(part))) + special for part, special in self.parts(text or ""))

    def prefix_counts(self, text: str) -> list[int]:
        """The token count of each prefix ``text[:i]`` of a text that is already normal and holds no special token, i from 0."""
        out, total, at = [0], 0, 0
        for m in self.plain_words.finditer(text.translate(self.stand_ins)):
            out += [total] * (m.start() - at)
            word = text[m.start() : m.end()]
            own, used = self.program.counts(self.mapped(word)), 0
            for c in word:
                used += len(c.encode())
                out.append(total + own[used])
            total += own[-1]
            at = m.end()
        return out + [total] * (len(text) - at)

    def truncate(self, text: str, budget: int) -> int:
        """The length of the longest prefix of a normal text that has at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return max(i for i, n in enumerate(counts) if n <= budget)


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row."""

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
