"""Fast exact encoding of whole texts with the tokenizers library.

Both vocabularies cut a text before merging, and no cut-out piece reaches over
a single blank or a line feed between two other characters, or from a letter to
marks after it. So the texts of a batch are taken apart there, the library
encodes each different word of the batch once, many in one call, and the ids of
a text are gathered from those of its words. Words stay known to the next
batches of the task until they are too many; then those of the last batch stay.
Of a vocabulary that lower-cases, so are words that only differ in ASCII case. A
text that holds the string of an added token goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Places where the parts of a text meet: one blank with no white space beside it.
_MEETING = re.compile(r"(?<=\S)(?= \S)")
# Byte-level vocabularies write bytes that do not print as the characters from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


class OddSpace(Exception):
    """A part that begins or ends with white space."""


class Remembered(dict):
    """Values by text. When full, it becomes the older half, and only what is asked for again comes back from there."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def keep(self, text: str, value) -> None:
        if len(text) < 200:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[text] = value


class PartCache(Remembered):
    """What each part of a text gives."""

    def __init__(self, make, limit: int):
        super().__init__(limit)
        self.make = make

    def __missing__(self, part: str):
        value = self.older.get(part)
        if value is None:
            if not part or part[0].isspace() or part[-1].isspace():
                raise OddSpace
            value = self.make(" " + part)
        self.keep(part, value)
        return value

    def of_text(self, text: str) -> list:
        """Values of the parts of a whole text, in order."""
        if not text:
            return []
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise OddSpace
            # The first part has no blank before it.
            return [self.make(first), *map(self.__getitem__, rest)]
        except OddSpace:
            return [self.make(part) for part in _MEETING.split(text)]


# White space other than single blanks and line feeds between other characters, for Arrow's regular expressions.
ODD_SPACE = (
    r"  | \n|\n |^[ \n]|[ \n]\z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


# Characters cut off the end of a word, and how the letters before them end.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoded:
    """Words and where their ids are, and which words the last batch had."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.batch = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")
        self.first = self.count = np.zeros(0, np.int64)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a list of words, one after the other, and where those of each end."""
        count = self.count[words]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[words] - (ends - count), count)
        return self.ids[at], ends


def in_slices(batches: Iterable[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``size`` bytes of a text column, to bound the memory of what is made of them; a longer text is a slice."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[stop - 1])


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    Gives what ``tokenizer.encode(text, add_special_tokens=False)`` gives, so
    the string of an added token in a text is that token.

    A word is kept with what is before it: a blank, not shown; line feeds, where
    the vocabulary has them, also for the first word of a text, whose id of a line
    feed is left out again; or nothing, shown as a tab, for marks cut off a word.
    """

    def __init__(self, vocabulary: str, chunk_chars: int = 1 << 10, slice_words: int = 200_000, known_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(vocabulary)
        added = tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.normalizer = tokenizer.normalizer
        # Some are looked for in the normalised text.
        self.normal = [tokenizer.normalizer.normalize_str(t.content) for t in added if t.normalized and tokenizer.normalizer is not None]
        self.chunk_chars, self.slice_words, self.known_words = chunk_chars, slice_words, known_words
        known = tokenizer.get_vocab()
        # Tokens that only a word begins with, as they begin with a blank or a line feed; none where the vocabulary leaves these out.
        self.heads = np.zeros(1 + max(known.values()), bool)
        self.heads[[i for token, i in known.items() if token.startswith((BYTE_LETTERS[0x20], BYTE_LETTERS[0x0A]))]] = True
        if self.heads[self.library("\na a\na")].sum() != 3:
            self.heads[:] = False
        # Or tokens that only a run of letters, a digit or a run of marks ends with.
        self.tails = np.zeros(len(self.heads), bool)
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        if suffix and not self.heads.any():
            self.tails[[i for token, i in known.items() if token.endswith(suffix)]] = True
        self.line_feed = self.library("\na")[: int(self.heads.any())]  # before the first word
        shown = json.loads(tokenizer.to_str())["normalizer"] or {}
        self.lower = any(n["type"] == "Lowercase" for n in shown.get("normalizers", [shown]) if n)

    def holding_added(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold the string of an added token."""
        found = np.zeros(len(texts), bool)
        for token in self.added:
            found |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if self.normal:
            for i in np.flatnonzero(~found).tolist():
                text = self.normalizer.normalize_str(texts[i].as_py())
                found[i] = any(map(text.__contains__, self.normal))
        return found

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    @staticmethod
    def words(text: str) -> list[str]:
        """A text with odd white space, cut at the blanks that words meet at."""
        first, *rest = _MEETING.split(text)
        return ["\t" + first, *(part[1:] for part in rest)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of different words, and where those of each word begin and how many they are."""
        count, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        found: list[np.ndarray] = []
        size = 0

        def add(ids: np.ndarray) -> None:
            nonlocal size
            found.append(ids)
            size += len(ids)

        def shown(chunk: list[int]) -> list[str]:
            """Words with the line feed or blank before them."""
            return [w if w[:1] == "\n" else " " + w for w in map(words.__getitem__, chunk)]

        def by_place(chunk: list[int]) -> None:
            """Words without white space around them, encoded as one text; the places of the tokens tell whose they are."""
            parts = shown(chunk)
            told = self.tokenizer.encode("".join(parts), add_special_tokens=False)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            at = np.fromiter((x for x, _ in told.offsets), np.int64, len(told.ids))
            owner = np.searchsorted(np.cumsum(sizes) - sizes, at, "right") - 1
            counts = np.bincount(owner, minlength=len(chunk))
            count[chunk] = counts
            first[chunk] = size + np.cumsum(counts) - counts
            add(np.array(told.ids, "<u4"))

        def by_token(waiting: list[list[int]]) -> None:
            """Chunks of words that have a head or tail each, at least; if there are no more, these tell where each word begins."""
            texts = ["".join(shown(chunk)) for chunk in waiting]
            for chunk, told in zip(waiting, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(told.ids, "<u4")
                if self.tails.any():
                    begins = np.flatnonzero(self.tails[ids]) + 1
                    good = len(begins) == len(chunk) and begins[-1] == len(ids)
                    begins = np.append(0, begins[:-1])
                else:
                    begins = np.flatnonzero(self.heads[ids])
                    good = len(begins) == len(chunk) and begins[0] == 0
                if not good:
                    # The normalised text has other blanks or parts.
                    by_place(chunk)
                    continue
                count[chunk], first[chunk] = np.diff(begins, append=len(ids)), size + begins
                add(ids)
            waiting.clear()

        tails, heads = bool(self.tails.any()), bool(self.heads.any())
        waiting: list[list[int]] = []
        simple: list[int] = []
        other: list[int] = []
        held = held_other = 0
        for i, word in enumerate(words):
            mark = word[:1]
            bare = word[1:] if mark == "\n" or mark == "\t" else word
            if mark == "\t" or not bare or bare[-1].isspace() or (bare[0].isspace() and bare[0] != "\n"):
                ids = self.library(bare if mark == "\t" else shown([i])[0])
                count[i], first[i] = len(ids), size
                add(ids)
            elif (heads and bare[0] != "\n") or (tails and bare.isalpha()):
                simple.append(i)
                held += len(word) + 1
                if held >= self.chunk_chars:
                    waiting.append(simple)
                    simple, held = [], 0
                    if len(waiting) >= 64:
                        by_token(waiting)
            else:
                other.append(i)
                held_other += len(word) + 1
                if held_other >= self.chunk_chars:
                    by_place(other)
                    other, held_other = [], 0
        if simple:
            waiting.append(simple)
        if waiting:
            by_token(waiting)
        if other:
            by_place(other)
        return np.concatenate(found) if found else np.zeros(0, "<u4"), first, count

    def encode_new(self, words: pa.Array, last: Encoded) -> tuple[Encoded, np.ndarray]:
        """What is known with the ids of different words, and the number of each word there."""
        if len(last.words) > self.known_words:
            last = self._recent(last)
        now, known = Encoded(), len(last.words)
        place = pc.fill_null(pc.index_in(words, value_set=last.words), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(place < 0)
        place[missing] = known + np.arange(len(missing))
        new = words.take(pa.array(missing))
        ids, first, count = self.encode_words(new.to_pylist())
        now.words, now.batch = pa.concat_arrays([last.words, new]), place
        now.ids = np.concatenate([last.ids, ids])
        now.first, now.count = np.concatenate([last.first, len(last.ids) + first]), np.concatenate([last.count, count])
        return now, place

    @staticmethod
    def _recent(last: Encoded) -> Encoded:
        """The words of the last batch alone."""
        kept = Encoded()
        kept.ids, ends = last.of(last.batch)
        kept.words = last.words.take(pa.array(last.batch))
        kept.count = last.count[last.batch]
        kept.first = ends - kept.count
        return kept

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Different words of texts without odd white space, the number of each word in order, and where each text begins.

        Marks after an ASCII or Latin-1 letter or a digit are cut off, since both vocabularies cut there.
        """
        if self.lower:
            # An accent may combine with a small letter only.
            texts = pc.if_else(pc.match_substring_regex(texts, r"\p{M}"), texts, pc.ascii_lower(texts))
        if len(self.line_feed):
            # Line feeds after each other stay together.
            lines = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
            for _ in range(2):
                lines = pc.replace_substring(lines, "\n \n", "\n\n")
        else:
            lines = pc.replace_substring(texts, "\n", " ")
        split = pc.split_pattern(lines, " ")
        offsets, words = split.offsets.to_numpy().astype(np.int64), split.values
        if not len(words):
            return words, np.zeros(0, np.int64), offsets
        bodies = pc.ascii_rtrim(words, MARKS)
        begins = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        sizes = pc.binary_length(bodies).to_numpy().astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)
        at = begins[:-1] + sizes
        end, before = raw[np.maximum(at - 1, 0)], raw[np.maximum(at - 2, 0)]
        low = end | 0x20
        letter = (low >= 0x61) & (low <= 0x7A) | (end >= 0x30) & (end <= 0x39)
        letter |= (before == 0xC3) & (end >= 0x80) & (end != 0x97) & (end != 0xB7) & (sizes > 1)
        marked = letter & (sizes > 0) & (at < begins[1:])
        coded = pc.if_else(pa.array(marked), bodies, words).dictionary_encode()
        which = np.flatnonzero(marked)
        # The marks are where they were, between the end of a word and the next word.
        places = np.empty(2 * len(which) + 1, np.int32)
        places[:-1:2], places[1::2], places[-1] = at[which], begins[which + 1], begins[which[-1] + 1] if len(which) else 0
        every = pa.StringArray.from_buffers(2 * len(which), pa.py_buffer(places), words.buffers()[2])
        marks = every.take(pa.array(np.arange(0, 2 * len(which), 2))).dictionary_encode()
        different = pa.concat_arrays([coded.dictionary, pa.array(["\t" + m for m in marks.dictionary.to_pylist()], pa.string())])
        after = np.concatenate([[0], np.cumsum(marked)])  # marks cut off before a word
        numbers = np.empty(len(words) + len(which), np.int64)
        numbers[np.arange(len(words)) + after[:-1]] = coded.indices.to_numpy()
        numbers[which + 1 + after[which]] = len(coded.dictionary) + marks.indices.to_numpy()
        return different, numbers, offsets + after[offsets]

    def encode_batches(self, batches: Iterable[pa.Array]) -> Iterator[Iterator[bytes]]:
        """For each batch of texts the ids of each text, in order."""
        last = Encoded()
        for texts in batches:
            whole = self.holding_added(texts)
            odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False) & ~whole
            plain = ~(whole | odd) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
            words, numbers, offsets = self.cut(texts.filter(pa.array(plain)))
            parts = {i: self.words(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
            extra = pa.array(chain.from_iterable(parts.values()), pa.string())
            coded = pa.concat_arrays([words, extra]).dictionary_encode()
            last, place = self.encode_new(coded.dictionary, last)
            place = place[coded.indices.to_numpy()]
            ends = len(words) + np.cumsum([len(p) for p in parts.values()], dtype=np.int64)
            own = {i: place[e - len(p) : e] for (i, p), e in zip(parts.items(), ends.tolist())}
            yield self._texts(texts, whole, own, plain, place[numbers], offsets, last)

    def _texts(self, texts, whole, parts, plain, numbers, offsets, known: Encoded) -> Iterator[bytes]:
        ready, lead = self._plain(numbers, offsets, known), 4 * len(self.line_feed)
        for i in range(len(texts)):
            if plain[i]:
                yield next(ready)[lead:]
            elif whole[i]:
                yield self.library(texts[i].as_py()).tobytes()
            elif i in parts:
                yield b"".join(self._gathered(parts[i], known))
            else:
                yield b""

    def _gathered(self, numbers: np.ndarray, known: Encoded) -> Iterator[bytes]:
        for at in range(0, len(numbers), self.slice_words):
            yield known.of(numbers[at : at + self.slice_words])[0].tobytes()

    def _plain(self, numbers: np.ndarray, offsets: np.ndarray, known: Encoded) -> Iterator[bytes]:
        """Ids of texts of numbered words, gathered for as many texts at once as the slice holds."""
        i, n = 0, len(offsets) - 1
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + self.slice_words, "right")) - 1
            if j <= i:
                yield b"".join(self._gathered(numbers[offsets[i] : offsets[i + 1]], known))
                i += 1
                continue
            ids, ends = known.of(numbers[offsets[i] : offsets[j]])
            raw = ids.tobytes()
            stops = (4 * ends[offsets[i + 1 : j + 1] - offsets[i] - 1]).tolist()
            for begin, stop in zip([0, *stops], stops):
                yield raw[begin:stop]
            i = j

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        return next(self.encode_batches([pa.array(texts, pa.string())]))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


_encoders: dict[str, TextEncoder] = {}


def encoder(vocabulary: str) -> TextEncoder:
    """One encoder per worker and vocabulary file."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = TextEncoder(vocabulary)
    return _encoders[vocabulary]
