"""Token ids through the ``tokenizers`` library, with a memo of words.

Byte-pair merges never cross a pre-token. Where a text can be cut at places that are certain to be
pre-token borders, each part is encoded by the library once and its ids are kept; a text is then
the concatenation of its parts. Every other text goes to the library whole, and so does a text that
holds the string of an added token (``<|endoftext|>``), which the library gives the token's own id.
Both give the same ids as the untouched library (tested on random Unicode text).

Memory: texts are put together up to ``GROUP_CHARS``, the memo has a bound in bytes, and a task
that ends gives back what it doesn't need (``MemoEncoder.settle``), as workers stay alive between
tasks beside a heap of their executor's full size.
"""

from __future__ import annotations

import array
import json
import os
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cartolith.llm.common import give_back

# The characters that are white space to the library or to Python, and plain letters.
_SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: White space at the start or beside white space, and the mark that parts use.
_ADJACENT = f"^[{_SPACES}]|[{_SPACES}][{_SPACES}]|\x01"
#: A full stop or comma that follows neither a plain letter nor a digit: it may belong to a longer run.
_LOOSE_STOP = f"(?:^|[^0-9{_LETTERS}])[.,]"
#: The pre-tokenizer pattern that drops white space (a fixed value of the vocabulary file).
_WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of plain letters, a pre-token each and not changed by composition; in marked texts also after the mark.
_PLAIN = f"^[{_LETTERS}]+$"
_PLAIN_MARKED = f"^\x01?[{_LETTERS}]+$"


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves; the others, in order, for the code points from 256.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_names()


def _text(s: str) -> pa.Scalar:
    return pa.scalar(s, pa.large_string())


#: Texts that are cut together have about so many characters, and one text more.
GROUP_CHARS = 3_000_000
#: Bytes that a generation of the memo may have, about.
MEMO_BYTES = 32 << 20
#: What a remembered word takes beside its letters and ids (measured on a dictionary of short strings).
ENTRY_BYTES = 150

_loaded: dict[str, "MemoEncoder"] = {}


def encoder(path: str) -> "MemoEncoder":
    """The encoder of a vocabulary file, one for each Python worker."""
    if path not in _loaded:
        _loaded[path] = MemoEncoder(path)
    return _loaded[path]


def grouped(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = GROUP_CHARS) -> Iterator[pa.Table]:
    """Batches put together until the texts of a column have about so many bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes
        if n >= most_bytes:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


class MemoEncoder:
    """Encodes texts to little-endian ids of 16 or 32 bits, by the vocabulary's size.

    The memo has two generations of at most ``memo_bytes`` each: a full young one becomes the old
    one, and what is asked for again moves back to the young one.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES, longest_part: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self._code = "H" if self.width == 2 else "I"
        self._kind = _kind(path)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._held, self._most, self._longest = 0, memo_bytes, longest_part
        self._model = self._tokenizer.model

    def settle(self) -> None:
        """Gives back memory at the end of a task; the young generation stays for the next one."""
        self._old = {}
        give_back()

    def _pack(self, ids: list[int]) -> bytes:
        a = array.array(self._code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, straight from the library's merges."""
        merge, flat, ends = self._model.tokenize, [], []
        for w in words:
            told = w.replace(" ", "\u0120") if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
            flat += [t.id for t in merge(told)]
            ends.append(len(flat))
        packed, width = self._pack(flat), self.width
        return [packed[width * a : width * b] for a, b in zip([0, *ends], ends)]

    def _marked(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(texts with a blank before each part, which of them can be cut).

        Texts with an added token, in whatever case, can't. ``spaced``: a single white-space character between two others is a border before it. A part
        stands for a blank and itself, or, with a mark, for what follows the mark. ``dropped``:
        blanks and line feeds are borders and give no ids. In both a full stop or comma after a
        plain letter or digit begins a part.
        """
        spaced = self._kind == "spaced"
        if not spaced and self._kind != "dropped":
            return texts, np.zeros(len(texts), dtype=bool)
        plain = np.ones(len(texts), dtype=bool)
        for token in self._added:
            plain &= ~pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        mark = " \1" if spaced else " "
        stops = texts
        for c in ",.":
            stops = pc.replace_substring(stops, c, mark + c)
        out = pc.if_else(pc.match_substring_regex(texts, _LOOSE_STOP), texts, stops)
        if not spaced:
            return pc.replace_substring(out, "\n", " "), plain
        out = pc.binary_join_element_wise(_text("\1"), pc.replace_substring(out, "\n", " \1\n \1"), _text(""))
        return out, plain & ~pc.match_substring_regex(texts, _ADJACENT).to_numpy(zero_copy_only=False)

    def _ask(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, by the library: of plain words by its merges, of others by all of it."""
        shape = _PLAIN if self._kind == "dropped" else _PLAIN_MARKED
        plain = pc.match_substring_regex(pa.array(parts, pa.large_string()), shape).to_numpy(zero_copy_only=False)
        if self._kind == "dropped":
            said = [p.lower() if x else p for p, x in zip(parts, plain.tolist())]
        else:
            said = [p[1:] if p[:1] == "\1" else " " + p for p in parts]
        out = [b""] * len(parts)
        for places, by in ((np.flatnonzero(plain).tolist(), self._words), (np.flatnonzero(~plain).tolist(), self._library)):
            for i, ids in zip(places, by([said[i] for i in places])):
                out[i] = ids
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        texts = list(texts)
        out: list[bytes] = []
        group, held = [], 0
        for t in texts:
            group.append(t)
            held += len(t)
            if held > GROUP_CHARS:
                out += self._encode_group(group)
                group, held = [], 0
        return out + self._encode_group(group) if group else out

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        marked, cut = self._marked(pa.array(texts, pa.large_string()))
        out: list[bytes] = [b""] * len(texts)
        whole = np.flatnonzero(~cut).tolist()
        if whole:
            for i, ids in zip(whole, self._library([texts[i] for i in whole])):
                out[i] = ids
        if cut.any():
            places = np.flatnonzero(cut)
            for i, ids in zip(places.tolist(), self._encode_parts(marked if len(places) == len(texts) else marked.take(pa.array(places)))):
                out[i] = ids
        return out

    def _encode_parts(self, marked: pa.Array) -> list[bytes]:
        """Encodes marked texts: each distinct part is looked up once, then put in its places."""
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        ids = self._of_parts(coded.dictionary.to_pylist())
        place = coded.indices.to_numpy()
        sizes = np.array([len(x) for x in ids], dtype=np.int64) // self.width
        each = sizes[place]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        joined = np.frombuffer(b"".join(ids), dtype=self.dtype)
        shift = (np.cumsum(sizes) - sizes)[place] - (ends - each)
        at = np.repeat(shift, each)
        at += np.arange(total)
        all_ids = joined[at].tobytes()
        borders = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()] * self.width
        return [all_ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        if self._held > self._most:
            self._old, self._young, self._held = self._young, {}, 0
        memo, old = self._young, self._old
        got: list[bytes | None] = list(map(memo.get, parts))
        unknown = [i for i, g in enumerate(got) if g is None]
        asked = []
        for i in unknown:
            if (ids := old.get(parts[i])) is None:
                asked.append(i)
            else:
                got[i] = memo[parts[i]] = ids
        for i, ids in zip(asked, self._ask([parts[i] for i in asked])):
            got[i] = ids
            if len(parts[i]) <= self._longest:
                memo[parts[i]] = ids
        self._held += sum(ENTRY_BYTES + len(parts[i]) for i in unknown)
        return got  # type: ignore[return-value]


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre, norm = told.get("pre_tokenizer") or {}, told.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    first = (pre.get("pretokenizers") or [{}])[0]
    steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == _WORDS_ONLY and first.get("invert"):
        return "dropped"
    return "whole"
