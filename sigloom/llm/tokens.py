"""Encoding with public tokenizers inside tasks: bounded per-worker caches in front of the libraries."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pre-tokens in a worker's cache before it is cut back; bounds its memory, never the result.
CACHE_ENTRIES = 800_000
#: Bytes of text that are cut up at once, and characters of a chunk that is worth keeping.
GROUP, LONGEST = 8 << 20, 64
#: Characters up to this one have no combining forms and lower case alone, so a chunk of them may be split before it is normalised.
_PLAIN = "ɏ"
#: Byte-level alphabet: a printable byte stands for itself, the others are numbered from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: No id's bytes: it parts the ids of chunks that are looked up together.
_END = b"\xff\xff\xff\xff"
_loaded: dict[str, object] = {}


def library(path: str):
    """The tokenizer of a .json file, loaded once per Python worker; each task encodes on its own core."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class SpaceDroppingEncoder:
    """Ids of texts under a tokenizer that drops white space and never joins across it.

    The texts of an Arrow batch are cut at spaces and their chunks numbered in Arrow, so that each distinct chunk is cut into
    pre-tokens, by the tokenizer's own pattern, once a batch. A bounded cache of pre-tokens stands before the library, so a word that
    comes with many kinds of punctuation or case is encoded once; when full it keeps what the last batch used, so frequent words stay.
    Chunks with special strings, or with letters whose normal form or lower case depends on their neighbours, go to the library whole.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer, self.entries = library(path), entries
        kind = json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        pattern = next(p["pattern"]["Regex"] for p in kind["pretokenizers"] if p["type"] == "Split")
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(pattern + "|\n").findall
        self.odd = re.compile("|".join([f"[^\x00-{_PLAIN}]", *special])).search
        self.words: dict[str, bytes] = {"\n": _END}

    def _learn_words(self, new: Iterable[str]) -> None:
        merge, words = self.tokenizer.model.tokenize, self.words
        for word in new:
            spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = [x.id for x in merge(spelt)]
            words[word] = struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks without spaces or line breaks."""
        some = bool(self.odd("\n".join(chunks)))
        plain = list(filterfalse(self.odd, chunks)) if some else chunks
        pretokens = self.find("\n".join(plain).lower())
        self._learn_words(set(filterfalse(self.words.__contains__, pretokens)))
        found = b"".join(map(self.words.__getitem__, pretokens)).split(_END)
        if some:
            split = iter(found)
            found = [np.asarray(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() if self.odd(c) else next(split) for c in chunks]
        if len(self.words) > self.entries:
            self.words = {w: self.words[w] for w in {"\n", *pretokens} if len(w) <= LONGEST}
        return found

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        for c in "\n\t\r":
            texts = pc.replace_substring(texts, c, " ")
        lists = pc.split_pattern(texts, " ")
        numbered = lists.flatten().dictionary_encode()
        # One string, split again: far faster than a Python string for each value.
        all_ = pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary.cast(pa.string()))
        distinct, codes = pc.binary_join(all_, " ")[0].as_py().split(" "), numbered.indices.to_numpy()
        known = self._ids(distinct)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        sizes, firsts = size[codes], (np.cumsum(size) - size)[codes]
        ends = np.r_[0, np.cumsum(sizes)]
        at = np.repeat(firsts - ends[:-1], sizes) + np.arange(ends[-1])
        return np.frombuffer(b"".join(known), "<u4")[at], ends[np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): all ids, unsigned 32-bit, and where each text's begin, with the end last; each text's are followed by ``end_id``, if given."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bytes_ = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]
        ids, offsets, at = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)], 0
        while at < len(texts):  # as many texts as have about GROUP bytes, one at least
            to = max(at + 1, int(np.searchsorted(bytes_, bytes_[at] + GROUP, side="right")) - 1)
            some, ends = self._batch(texts.slice(at, to - at))
            ids.append(some if end_id is None else np.insert(some, ends[1:], end_id))
            offsets.append(offsets[-1][-1] + ends[1:] + (0 if end_id is None else np.arange(1, to - at + 1)))
            at = to
        return np.concatenate(ids), np.concatenate(offsets)

    def id_bytes(self, text: str | None) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0].tobytes()


def encoder(path: str) -> SpaceDroppingEncoder:
    """One encoder per Python worker and file, so its cache outlives a task."""
    if ("encoder", path) not in _loaded:
        _loaded["encoder", path] = SpaceDroppingEncoder(path)
    return _loaded["encoder", path]
