"""Encoding with the tokenizers library, each distinct stretch between white space once.

The two tokenizers used here never form a token over the border between a character and white space after it, and
white space is the same set for them. So the ids of a text are those of its stretches, put together. Arrow splits the
texts and tells stretches apart; numpy gathers their ids. Texts that hold the string of a special token are encoded as
a whole, since the library finds such strings before it looks at anything else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from packetloom.llm.common import u32

# Unicode's White_Space, which the tokenizers' patterns call \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The same but for blanks and line ends, for Arrow; Arrow's own white space has \x1c-\x1f besides.
OTHER_SPACE = r"[\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = rf"^[ \n]|[ \n]$|[ \n][ \n]|{OTHER_SPACE}"
# Punctuation behind a letter or digit is never one token with it, so it is a stretch of its own: fewer different ones.
ENDING = r"([A-Za-z0-9])([.,;:!?)]+)([ \n]|$)"
CACHED_STRETCHES = 400_000
SLICE = 1 << 18  # stretches whose ids are gathered at once


def parts_of(texts: list[str], rows: int = 1000, characters: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts): runs of texts that are encoded together; a longer text is a run of its own."""
    begin = held = 0
    for k, text in enumerate(texts):
        if k > begin and (k - begin >= rows or held + len(text) > characters):
            yield begin, texts[begin:k]
            begin, held = k, 0
        held += len(text)
    if texts:
        yield begin, texts[begin:]


class _Known:
    """Ids of stretches, one after the other."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 16, dtype="<u4")
        self.ends = np.zeros(1 << 16, dtype=np.int64)  # of stretch k at k + 1

    def extend(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        count = len(self.number)
        begin = int(self.ends[count])
        if begin + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), begin + len(ids)), dtype="<u4")])
        if count + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), count + len(keys) + 1), dtype=np.int64)])
        self.ids[begin : begin + len(ids)] = ids
        self.ends[count + 1 : count + 1 + len(keys)] = begin + np.cumsum(lengths)
        self.number.update(zip(keys, range(count, count + len(keys)), strict=True))

    def gathered(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the stretches of these numbers, how many each has)."""
        begins = self.ends[which]
        lengths = self.ends[which + 1] - begins
        after = np.cumsum(lengths)
        places = np.repeat(begins - (after - lengths), lengths)
        places += np.arange(len(places))
        return self.ids.take(places), lengths


class StretchEncoder:
    """Encodes batches of texts to little-endian unsigned 32-bit ids, as the library does without adding special tokens.

    ``spaces``: whether white space belongs to the stretch behind it (tokens for it) or is dropped by the tokenizer.
    Stretches are kept until they are too many; then those of the batches since are kept and older ones looked up once more.
    """

    SPACES = frozenset(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

    def __init__(self, path: str, spaces: bool) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        self.between_id, self.between = next((k, t.content) for k, t in added.items() if t.special)
        self.spaces = spaces
        if spaces:  # a token of a byte-level vocabulary has one character for each of its bytes
            vocabulary = self.library.get_vocab(with_added_tokens=False)
            self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.stretches = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+" if spaces else f"[^{SPACE}]+")
        self.known, self.older = _Known(), _Known()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        held = np.zeros(len(texts), dtype=bool)
        for special in self.specials:
            held |= _found(pc.match_substring(column, special))
        if self.spaces:
            odd = _found(pc.match_substring_regex(column, UNEVEN)) | (pc.binary_length(column).to_numpy(zero_copy_only=False) == 0)
        else:
            odd = _found(pc.match_substring_regex(column, r"[\x1c-\x1f]|\p{M}"))
        even = np.flatnonzero(~odd & ~held)
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(even.tolist(), self._of_lists(self._split_even(column.take(pa.array(even)))), strict=True):
            out[k] = ids
        uneven = np.flatnonzero(odd & ~held).tolist()
        lists = pa.array([self._keys(texts[k]) for k in uneven], pa.large_list(pa.large_string()))
        for k, ids in zip(uneven, self._of_lists(lists), strict=True):
            out[k] = ids
        for k in np.flatnonzero(held).tolist():
            out[k] = u32(self.library.encode(texts[k], add_special_tokens=False).ids)
        return out

    def _split_even(self, texts: pa.Array) -> pa.Array:
        """Keys of the stretches of texts whose white space is single blanks and line ends between others."""
        if not self.spaces:  # this tokenizer has no capitals; without combining marks they may go before it puts characters together
            return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), ENDING, r"\1 \2\3"))
        texts = pc.replace_substring_regex(texts, ENDING, "\\1 \r\\2\\3")
        first, nothing = pa.scalar("\r", texts.type), pa.scalar("", texts.type)
        marked = pc.binary_join_element_wise(first, pc.replace_substring(texts, "\n", " \n"), nothing)
        return pc.split_pattern(marked, " ")

    def _keys(self, text: str) -> list[str]:
        """A text's stretches by their keys: without the blank before them; "\\r" before those that have no white space before them."""
        found = self.stretches.findall(text)
        if not self.spaces:
            return found
        return [s[1:] if len(s) > 1 and s[0] == " " and s[1] not in "\r\n " else "\r" + s for s in found]

    def _stretch_of(self, key: str) -> str:
        if not self.spaces:
            return key
        return key[1:] if key[0] == "\r" else key if key[0] == "\n" else " " + key

    def _of_lists(self, lists: pa.Array) -> Iterator[bytes]:
        """The ids of each list of keys."""
        coded = lists.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())
        order = coded.indices.to_numpy(zero_copy_only=False)
        parts, at = [], np.zeros(len(order) + 1, dtype=np.int64)
        for k in range(0, len(order), SLICE):
            ids, lengths = self.known.gathered(numbers[order[k : k + SLICE]])
            parts.append(ids.tobytes())
            at[k + 1 : k + 1 + len(lengths)] = at[k] + np.cumsum(lengths)
        data, bounds = b"".join(parts), 4 * at[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        bounds = bounds.tolist()
        return (data[b:e] for b, e in zip(bounds, bounds[1:], strict=False))

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """Numbers of the keys among the known stretches, after those that are new are encoded."""
        if len(self.known.number) > CACHED_STRETCHES:
            self.known, self.older = _Known(), self.known
        known, older = self.known, self.older.number
        missing = [key for key in keys if key not in known.number]
        again = [key for key in missing if key in older]
        if again:
            known.extend(again, *self.older.gathered(np.array([older[key] for key in again])))
        self._encode_new([key for key in missing if key not in older] if again else missing)
        return np.fromiter(map(known.number.__getitem__, keys), dtype=np.int64, count=len(keys))

    def _encode_new(self, keys: list[str]) -> None:
        """Take in new stretches, many in one call of the library."""
        stretches = list(map(self._stretch_of, keys))
        behind_space = [self.spaces and len(s) > 1 and s[0] in " \n" and s[1] not in self.SPACES for s in stretches]
        for running, size, encode in ((True, 256, self._of_running), (False, 64, self._of_parted)):
            some = [k for k, r in enumerate(behind_space) if r == running]
            for begin in range(0, len(some), size):
                now = some[begin : begin + size]
                self.known.extend([keys[k] for k in now], *encode([stretches[k] for k in now]))

    def _of_running(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Stretches that begin with white space, as one text: byte-level tokens cover its bytes, so lengths tell whose they are."""
        ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum([len(s.encode()) for s in some])
        covered = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(covered, ends) + 1
        if len(covered) != cuts[-1] or (covered[cuts - 1] != ends).any():
            raise ValueError("a token crosses the border of a stretch")
        return ids, np.diff(cuts, prepend=0)

    def _of_parted(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """With a special token between each two, which the library encodes apart from one another."""
        ids = np.array(self.library.encode_batch_fast([self.between.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
        between = ids == self.between_id
        ends = np.append(np.flatnonzero(between), len(ids))
        if len(ends) != len(some):
            raise ValueError("a stretch makes a special token")
        return ids[~between], np.diff(ends, prepend=-1) - 1


def _found(matches: pa.Array) -> np.ndarray:
    return matches.to_numpy(zero_copy_only=False).astype(bool)


@cache
def stretch_encoder(path: str, spaces: bool) -> StretchEncoder:
    """One for each worker process, so that later tasks know the stretches of earlier ones."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    return StretchEncoder(path, spaces)
