"""Exact batch encoding with a public tokenizer, cut at places where the tokenizer itself always cuts.

The tokenizers library is called for distinct chunks only; Arrow splits the texts, numbers the
chunks and lays the ids out again. A cut is made only where no pre-token can reach across it:

* ``word`` (white space dropped): at ASCII white space;
* ``byte`` (byte-level, a blank belongs to the next word): before a single blank that stands
  between two characters that aren't white space. Texts with any other blank go whole to the library.

So the ids are those of the library for the whole text; tests hold them against it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
MOST_WORDS = 350_000
ODD_BLANKS = "(^ )|( $)|([\\s\\x{85}\\p{Z}\\x1c-\\x1f] )|( [\\s\\x{85}\\p{Z}\\x1c-\\x1f])"


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer's version: its file and the library that runs it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + tokenizers.__version__.encode()).hexdigest()
#: Latin letters (composed, without the one whose lower case is two characters), then signs of ASCII but the apostrophe.
PLAIN = "^(?P<letters>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<signs>[!-&(-/:-;=?@\\[-`{}~]*)$"
#: Patterns of the two files that PLAIN's cut was checked against; a tokenizer with another pattern encodes texts whole.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SINGLE_BREAKS = "([^\\s\\x{85}\\p{Z}\\x1c-\\x1f])\n([^\\s\\x{85}\\p{Z}\\x1c-\\x1f])"


def _byte_chars() -> dict[int, int]:
    """Byte-level BPE's visible character for each byte: printable ones stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip([*shown, *(b for b in range(256) if b not in shown)], [*shown, *range(256, 512)], strict=False))


BYTE_CHARS = _byte_chars()
BYTE_CHARS_OF_BREAK = chr(BYTE_CHARS[10])


class Words:
    """The ids of the words met lately, as Arrow arrays (some forty bytes a word): ``most`` and those of one slice at most."""

    def __init__(self, encode: Callable[[list[str]], pa.LargeListArray], most: int = MOST_WORDS):
        self.encode, self.most = encode, most
        self.words, self.ids = pa.array([], pa.large_string()), encode([])

    def listed(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = at.is_null().to_numpy(zero_copy_only=False)
            known, n = pc.fill_null(at, 0).to_numpy(), len(self.words)
            fresh = words.filter(pa.array(new))
            self.words, self.ids = pa.concat_arrays([self.words, fresh]), pa.concat_arrays([self.ids, self.encode(fresh.to_pylist())])
            at = pa.array(np.where(new, n + np.cumsum(new) - 1, known))
        found = self.ids.take(at)
        if len(self.words) > self.most:
            self.words, self.ids = words, found
        return found


class Encoder:
    """Encodes Arrow string arrays."""

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        level = [s for s in steps if s["type"] == "ByteLevel"]
        split = [s.get("pattern", {}).get("Regex") for s in steps if s["type"] == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        self.kind = "whole"
        if plain and split == [WORD_PATTERN] and len(steps) == len(split) + len(level):
            self.kind = "word"
        elif plain and spec.get("normalizer") is None and len(steps) == 1 and level and level[0].get("use_regex") and not level[0].get("add_prefix_space"):
            self.kind = "byte"
        self.model = self.tokenizer.model
        self.spaced = Words(lambda words: self._pieces(words, "\u0120" if self.kind == "byte" else ""))
        self.bare = Words(self._pieces)
        self.signs = Words(self._pieces, 10_000)

    def _raw(self, texts: list[str]) -> pa.LargeListArray:
        """Ids of whole texts by the library."""
        return self._listed([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _pieces(self, pieces: list[str], lead: str = "") -> pa.LargeListArray:
        """Ids of pre-tokens of one kind of character, each after ``lead``, from the library's model alone."""
        text = "\n".join(pieces)
        if self.kind == "word":
            text = text.lower()
        shown = text.encode().decode("latin-1").translate(BYTE_CHARS).split(BYTE_CHARS_OF_BREAK) if pieces else []
        some = [self._listed([[t.id for t in self.model.tokenize(lead + p)] for p in shown[a : a + 20_000]]) for a in range(0, max(1, len(shown)), 20_000)]
        return pa.concat_arrays(some)

    @staticmethod
    def _listed(found: list[list[int]]) -> pa.LargeListArray:
        ends = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=ends[1:])
        return pa.LargeListArray.from_arrays(ends, pa.array(np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1]))))

    def _chunks(self, chunks: pa.Array, words: Words, lead: str) -> pa.LargeListArray:
        """Ids of distinct chunks: letters and the signs after them are two pre-tokens, which need no normalising but lower case; others go to the library."""
        cut = pc.extract_regex(chunks, PLAIN)
        ok = cut.is_valid().to_numpy(zero_copy_only=False)
        letters, signs = (cut.field(k).filter(pa.array(ok)).dictionary_encode() for k in (0, 1))
        hard = [lead + c for c in chunks.filter(pa.array(~ok)).to_pylist()]
        known = pa.concat_arrays([words.listed(letters.dictionary), self.signs.listed(signs.dictionary), self._raw(hard)])
        first, then = np.empty(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
        first[ok] = letters.indices.to_numpy()
        then[ok] = signs.indices.to_numpy()
        n, m = len(letters.dictionary), len(signs.dictionary)
        then += n
        first[~ok] = n + m + np.arange(len(hard))
        pairs = np.stack([first, then], axis=1)
        sizes = np.where(ok, 2, 1)
        both = known.take(pa.array(pairs.reshape(-1)[np.stack([np.ones(len(ok), bool), ok], axis=1).reshape(-1)]))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return pa.LargeListArray.from_arrays(both.offsets.to_numpy()[starts], both.values)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text's first id (with the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.kind == "whole" or not len(texts):
            found = self._raw(texts.to_pylist())
            return found.values.to_numpy(), found.offsets.to_numpy().astype(np.int64)
        if self.kind == "word":
            parts = pc.ascii_split_whitespace(texts)
        else:
            odd = pc.match_substring_regex(texts, ODD_BLANKS)
            rest = pc.if_else(odd, "", texts)
            parts = pc.split_pattern(pc.replace_substring_regex(rest, SINGLE_BREAKS, "\\1 \n\\2"), " ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        flat = parts.flatten().dictionary_encode()
        chunks, at = flat.dictionary.cast(pa.large_string()), flat.indices.to_numpy()
        if self.kind == "word":
            listed = self._chunks(chunks, self.spaced, "")
        else:
            # Chunks stand after a blank, after a line break, or first in their text; odd texts are encoded whole.
            broken = pc.starts_with(chunks, "\n").to_numpy(zero_copy_only=False)
            after = self._chunks(chunks.filter(pa.array(~broken)), self.spaced, " ")
            lines = pc.utf8_slice_codeunits(chunks.filter(pa.array(broken)), 1)
            firsts = ends[:-1]  # split_pattern gives each text one part at least
            heads = chunks.take(pa.array(at[firsts])).dictionary_encode()
            bare = self._chunks(pa.concat_arrays([lines, heads.dictionary]), self.bare, "")
            whole, one_break = self._raw(texts.filter(odd).to_pylist()), self._raw(["\n"])
            listed = pa.concat_arrays([after, bare, whole, one_break])
            n, k, m = len(after), len(lines), len(listed)
            pairs = listed.take(pa.array(np.stack([np.full(k, m - 1), n + np.arange(k)], axis=1).reshape(-1)))
            listed = pa.concat_arrays([listed, pa.LargeListArray.from_arrays(pairs.offsets.to_numpy()[::2], pairs.values)])
            place = np.where(broken, m + np.cumsum(broken) - 1, np.cumsum(~broken) - 1)
            at = place[at]
            at[firsts] = n + k + heads.indices.to_numpy()
            at[firsts[odd.to_numpy(zero_copy_only=False)]] = n + len(bare) + np.arange(len(whole))
        out = listed.take(pa.array(at))
        del listed, flat, parts, chunks, at
        pa.default_memory_pool().release_unused()
        return out.values.to_numpy(), out.offsets.to_numpy()[ends]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_BYTES`` of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after those of each text."""
    return np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4"), ends + np.arange(len(ends))


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
