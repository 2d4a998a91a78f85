"""Tokenising blocks of texts: each distinct part of a block is encoded once.

A tokenizer whose tokens never reach over certain places gives a text's ids as
the ids of the parts between them, one after the other. Prose repeats its words,
so a block of some ten thousand documents has about a tenth as many distinct
parts as parts. Vocabulary files travel as a Spark broadcast (about 2 MB each);
executors need the tokenizer libraries, no files.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that one library call encodes at most; each result holds far more than its ids.
CALL = 4_000
#: Words whose ids a task keeps.
WORDS = 300_000

#: Every character that either library may take for white space.
_WIDE = (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = r"\t-\r\x1c-\x1f\x20" + "".join(map(chr, _WIDE))


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of at most ``limit`` bytes of text, or a single text; null texts are empty."""
    held, size = [], 0
    for batch in batches:
        ids, texts = batch.column(0).cast(pa.int64()), pc.fill_null(batch.column(1), "")
        start = 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            if size and size + n > limit:
                held.append((ids.slice(start, i - start), texts.slice(start, i - start)))
                yield tuple(pa.concat_arrays(x) for x in zip(*held))
                held, size, start = [], 0, i
            size += n
        held.append((ids.slice(start), texts.slice(start)))
    if sum(len(x) for x, _ in held):
        yield tuple(pa.concat_arrays(x) for x in zip(*held))


class Parts:
    """The parts of a block's documents: ``values`` distinct, ``index`` into them in order, ``of`` the document of each."""

    def __init__(self, lists: pa.ListArray):
        coded = lists.flatten().dictionary_encode()
        self.values: list[str] = coded.dictionary.to_pylist()
        self.index = coded.indices.to_numpy(zero_copy_only=False)
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def total(self, per_value: np.ndarray) -> np.ndarray:
        """Per document, the sum over its parts."""
        sums = np.zeros(len(self.index) + 1, np.int64)
        np.cumsum(per_value[self.index], out=sums[1:])
        return sums[self.starts + self.sizes] - sums[self.starts]


def _split(ids: pa.Array, texts: pa.Array, odd: pa.Array, plain, other) -> tuple[pa.Array, pa.Array, Parts]:
    """Parts by ``plain`` (on arrays), those of ``odd`` texts by ``other`` (one text at a time); plain documents come first."""
    odd_texts = texts.filter(odd)
    lists = plain(texts.filter(pc.invert(odd)))
    ids, texts = (pa.concat_arrays([x.filter(pc.invert(odd)), x.filter(odd)]) for x in (ids, texts))
    if len(odd_texts):
        lists = pa.concat_arrays([lists, pa.array([other(t) for t in odd_texts.to_pylist()], lists.type)])
    return ids, texts, Parts(lists)


_SINGLE_SPACE = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def split_at_spaces(ids: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, Parts]:
    """Cut texts at each space that stands alone between characters that are no white space.

    Byte-level BPE and piece BPE both begin a token with such a space (the
    latter where no piece has a space behind another character), and never reach
    over it from the left. So space + text is encoded as space + part for each part.
    """
    s = SPACE
    odd = pc.match_substring_regex(texts, f"^[{s}]|[{s}]$| [{s}]|[{s}] ")
    return _split(ids, texts, odd, lambda t: pc.split_pattern(t, " "), _SINGLE_SPACE.split)


def split_at_white(ids: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, Parts]:
    """Cut texts at their white space. Texts with a character whose kind the libraries may see differently stay whole."""
    odd = pc.match_substring_regex(texts, r"[\x1c-\x1f\x{85}\x{180e}]")
    return _split(ids, texts, odd, pc.utf8_split_whitespace, lambda t: [t])


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoded:
    """Token ids of many texts in one array, from each text's ids as bytes; ``counts`` of each text."""

    def __init__(self, packed_ids: Iterable[bytes]):
        listed = list(packed_ids)
        self.counts = np.fromiter(map(len, listed), np.int64, len(listed)) // 4
        self.ids = np.frombuffer(b"".join(listed), np.int32)
        self.starts = np.cumsum(self.counts) - self.counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges starts[i] .. starts[i] + counts[i], one after the other."""
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(int(counts.sum()))


def in_calls(texts: list[str], encode) -> Iterator[bytes]:
    for i in range(0, len(texts), CALL):
        yield from map(packed, encode(texts[i : i + CALL]))


def byte_level_table() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def json_tokenizer(spec: bytes):
    """A ``tokenizers`` tokenizer from its JSON, without threads of its own: Spark runs one task a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec.decode("utf-8"))


#: A run of letters with at most one full stop or comma behind it: what most parts of prose are.
SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


class Words:
    """Ids of words, kept from block to block, up to ``WORDS`` of them (some 50 MB); beyond, it starts anew."""

    def __init__(self, encode):
        self.encode, self.known = encode, {}

    def __getitem__(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= WORDS:
                self.known.clear()
            found = self.known[word] = packed(self.encode(word))
        return found


def encode_parts(parts: list[str], words: Words, tail: dict[str, bytes], whole, key=str) -> Encoded:
    """Ids of parts: those of one word and its mark by ``words`` and ``tail``, others by ``whole``."""
    simple = [SIMPLE.fullmatch(p) for p in parts]
    rest = whole([p for p, m in zip(parts, simple) if not m])
    return Encoded(words[key(m[1])] + tail[m[2]] if m else next(rest) for m in simple)


class ByteLevelBpe:
    """Byte-level BPE; special tokens' strings are plain text.

    With the usual pattern a word and the mark behind it are two units of their own, so
    words go to the BPE model directly, each distinct one once.
    """

    def __init__(self, spec: bytes):
        self.tokenizer = json_tokenizer(spec)
        self.tokenizer.encode_special_tokens = True
        d = json.loads(spec)
        cut = d.get("pre_tokenizer") or {}
        self.by_word = d.get("normalizer") is None and (cut.get("type"), cut.get("use_regex")) == ("ByteLevel", True)
        byte = byte_level_table()
        self.char = {b: c for c, b in byte.items()}
        vocabulary = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.bytes: list[bytes] = [b""] * (vocabulary[-1][1] + 1)
        for token, i in vocabulary:
            self.bytes[i] = bytes(byte[c] for c in token)
        self.tail = {c: next(self._whole([c])) for c in ("", ".", ",")}
        self.words = Words(self._word)

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        return in_calls(texts, lambda call: [e.ids for e in self.tokenizer.encode_batch(call, add_special_tokens=False)])

    def _word(self, word: str) -> list[int]:
        if word.isascii():  # letters, and a space perhaps
            word = word.replace(" ", self.char[32])
        else:
            word = "".join(map(self.char.__getitem__, word.encode("utf-8")))
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def encode(self, texts: list[str]) -> Encoded:
        return encode_parts(texts, self.words, self.tail, self._whole) if self.by_word else Encoded(self._whole(texts))


class PieceBpe:
    """Piece BPE with byte fallback; the model puts a space before each text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = list(range(self.model.get_piece_size()))
        pieces = self.model.id_to_piece(ids)
        single = self.model.is_byte(ids)
        self.bytes = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for b, p in zip(single, pieces)]
        #: Whether a space always begins a token.
        self.splits_at_spaces = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> Encoded:
        return Encoded(in_calls(texts, lambda call: self.model.encode(call, num_threads=1)))


class WordBpe:
    """Word BPE (lower case, white space dropped, word ends marked): the ids of parts between white space.

    Words go to the BPE model itself, each lower-cased word once; all other parts go through the
    whole tokenizer, special tokens' strings included.
    """

    #: The normaliser and the pattern that make words independent of what stands beside them; other tokenizers get whole texts.
    STEPS = [["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]

    def __init__(self, spec: bytes):
        self.tokenizer = json_tokenizer(spec)
        d = json.loads(spec)
        steps = (d.get("normalizer") or {}).get("normalizers", [])
        cuts = (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = [[s["type"] for s in steps], cuts[0].get("pattern", {}).get("Regex")] == self.STEPS
        self.tail = {c: next(self._whole([c])) for c in ("", ".", ",")}
        self.words = Words(self._word)

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        return in_calls(texts, lambda call: [e.ids for e in self.tokenizer.encode_batch(call, add_special_tokens=False)])

    def _word(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word))
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def split(self, ids: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, Parts]:
        if self.by_word:
            return split_at_white(ids, texts)
        return ids, texts, Parts(pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32), texts))

    def encode(self, parts: list[str]) -> Encoded:
        return encode_parts(parts, self.words, self.tail, self._whole, str.lower) if self.by_word else Encoded(self._whole(parts))
