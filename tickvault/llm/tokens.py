"""Ids of whole texts by a given tokenizers file, looked up by white-space-bounded pieces.

Both vocabularies used here split a text before their merges in such a way that a
piece boundary always lies before white space that follows a visible character, and
nothing before such a place changes what follows it. So a text may be cut there, and
a piece of letters again before its closing marks. The distinct parts of a batch are
looked up in an Arrow table of those met before; only new ones go to the tokenizers
library. Texts are cut and their parts numbered by Arrow, a batch at a time; ids are
gathered by numpy, with no Python object per word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickvault.llm.common import kept

ENCODERS = "piece encoders"
# Lookups hash the whole table for each batch, so a larger one takes more memory and no less time.
CACHE_ENTRIES = 300_000
CACHED_CHARS = 64
JOINED = 200
# Texts handed to the library at a time: it keeps much beside the ids of each.
HANDED = 64

# The characters of the Unicode property White_Space.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
# Texts that the plain cut at spaces and line feeds does not fit: white space beside white
# space, at the start, or the mark that stands for the start. The class is that of RE2.
_UNEVEN = "[\\s\\x0b\\x{85}\\p{Z}][\\s\\x0b\\x{85}\\p{Z}]|^[ \\x00]|\\x00"
_START = "\0"
# Letters (of Latin blocks, whose lower case are letters too) and closing marks after them.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+"
_PARTS = f'^(?P<line>\n?)(?P<word> ?{_LETTERS})(?P<marks>[.,;:!?#$%&*)"]*)$'


def _taken(pool: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, ``n`` values from ``begin`` on each, one after the other."""
    ends = np.cumsum(n)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)]


class PieceEncoder:
    """Ids of texts, as the tokenizers library gives them without adding special tokens; the
    string of an added token in a text is that token. ``spaced`` says whether the vocabulary
    keeps white space, as the beginning of the piece after it, or drops it."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # In any case: lower case would make an added token of its upper-case string.
        self.added = "(?i)" + "|".join(map(re.escape, added)) if added else None
        # Where a word begins (a space in it) or ends (the mark of a word's end).
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("\u0120") if spaced else token.endswith("</w>")
        self.plain = f"^{' ' if spaced else ''}{_LETTERS}$"
        # The parts met before, and of each the place and number of its ids.
        self.known = pa.array([], pa.large_string())
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _handed(self, texts: list[str]) -> Iterator[np.ndarray]:
        for a in range(0, len(texts), HANDED):
            for e in self.tokenizer.encode_batch_fast(texts[a:a + HANDED], add_special_tokens=False):
                yield np.asarray(e.ids, np.uint32)

    def _words(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids, and how many each has, of words that are letters alone, encoded many to a text
        and parted at their edges."""
        cuts = np.append(np.arange(0, len(words), JOINED), len(words))
        groups = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.cast(pa.string()))
        all_ids, sizes = [], []
        for k, ids in enumerate(self._handed(pc.binary_join(groups, "" if self.spaced else " ").to_pylist())):
            at = np.flatnonzero(self.edge[ids])
            if len(at) == cuts[k + 1] - cuts[k]:
                all_ids.append(ids)
                sizes.append(np.diff(np.append(at, len(ids)) if self.spaced else np.append(-1, at)))
            else:
                each = list(self._handed(groups[k].as_py()))
                all_ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        return all_ids, sizes

    def rows(self, parts: pa.Array) -> np.ndarray:
        """The rows of distinct ``parts`` in the table, where new ones are added."""
        at = pc.index_in(parts, value_set=self.known)
        new = at.is_null()
        rows = at.fill_null(0).to_numpy().astype(np.int64)
        if at.null_count:
            added = parts.filter(new)
            plain = pc.match_substring_regex(added, self.plain)
            words, other = added.filter(plain), added.filter(pc.invert(plain))
            ids, sizes = self._words(words) if len(words) else ([], [])
            for each in self._handed(other.to_pylist()):
                ids.append(each)
                sizes.append(np.array([len(each)], np.int64))
            plain, base = plain.to_numpy(zero_copy_only=False), len(self.known)
            place = np.empty(len(added), np.int64)
            place[plain] = base + np.arange(len(words))
            place[~plain] = base + len(words) + np.arange(len(other))
            rows[new.to_numpy(zero_copy_only=False)] = place
            self.known = pa.concat_arrays([self.known, words, other])
            self.ids = np.concatenate([self.ids, *ids])
            self.size = np.concatenate([self.size, *sizes])
            self.begin = np.cumsum(self.size) - self.size
        return rows

    def _forget(self, used: np.ndarray) -> None:
        """Keep the table bounded: long parts are not kept at all, and where there are too many,
        those of the last batch alone are."""
        keep = pc.less_equal(pc.utf8_length(self.known), CACHED_CHARS).to_numpy(zero_copy_only=False)
        if keep.sum() > CACHE_ENTRIES:
            last = np.zeros(len(keep), bool)
            last[used] = True
            keep &= last if (keep & last).sum() <= CACHE_ENTRIES else False
        if not keep.all():
            self.ids = _taken(self.ids, self.begin[keep], self.size[keep])
            self.known, self.size = self.known.filter(pa.array(keep)), self.size[keep]
            self.begin = np.cumsum(self.size) - self.size

    def _coded(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in turn, and how many each has."""
        found = pc.extract_regex(names, _PARTS)
        whole = found.is_null()
        none = pa.scalar("", names.type)
        columns = [pc.if_else(whole, none, found.field("line")), pc.if_else(whole, names, found.field("word")),
                   pc.if_else(whole, none, found.field("marks"))]
        parts = pa.concat_arrays(columns).dictionary_encode()
        used = self.rows(parts.dictionary)
        rows = used[parts.indices.to_numpy()].reshape(len(columns), -1)
        out = _taken(self.ids, self.begin[rows.T.ravel()], self.size[rows.T.ravel()])
        n = self.size[rows].sum(axis=0)
        self._forget(used)
        return out, n

    def _uneven(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [_PIECES.findall(t) for t in texts]
        column = pa.array([p for x in pieces for p in x], pa.large_string()).dictionary_encode()
        return self._texts(column, np.cumsum([0, *map(len, pieces)]), column.dictionary)

    def _texts(self, pieces: pa.DictionaryArray, cuts: np.ndarray, names: pa.Array) -> list[np.ndarray]:
        """Ids of each text, whose pieces lie between two ``cuts``."""
        pool, sizes = self._coded(names)
        which = pieces.indices.to_numpy()
        n = sizes[which]
        ids = _taken(pool, (np.cumsum(sizes) - sizes)[which], n)
        bounds = np.append(0, np.cumsum(n))[cuts].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        whole = np.zeros(len(texts), bool)
        if self.added:
            # Added tokens are found in the text as it is, so such a text is encoded whole.
            whole = pc.match_substring_regex(column, self.added).to_numpy(zero_copy_only=False)
            if whole.any():
                column = pc.if_else(pa.array(whole), pa.scalar("", column.type), column)
        uneven = np.zeros(len(texts), bool)
        if self.spaced:
            uneven = pc.match_substring_regex(column, _UNEVEN).to_numpy(zero_copy_only=False)
            column = pc.if_else(pa.array(uneven), pa.scalar("", column.type), column)
            column = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_START, column.type), column, pa.scalar("", column.type)), "\n", " \n")
        else:
            # Lower case is the same to this vocabulary, so fewer pieces are distinct.
            column = pc.ascii_lower(column)
            for c in "\t\n\x0b\x0c\r":
                column = pc.replace_substring(column, c, " ")
        lists = pc.split_pattern(column, " ")
        del column
        flat = lists.flatten().dictionary_encode()
        names = flat.dictionary
        if self.spaced:
            after = pc.binary_join_element_wise(pa.scalar(" ", names.type), names, pa.scalar("", names.type))
            first = pc.starts_with(names, _START)
            names = pc.if_else(pc.starts_with(names, "\n"), names,
                               pc.if_else(first, pc.utf8_slice_codeunits(names, 1), after))
        out = self._texts(flat, lists.offsets.to_numpy(), names)
        at = np.flatnonzero(uneven).tolist()
        for i, ids in zip(at, self._uneven([texts[i] for i in at]) if at else ()):
            out[i] = ids
        at = np.flatnonzero(whole).tolist()
        for i, ids in zip(at, self._handed([texts[i] for i in at])):
            out[i] = ids
        return out


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """The encoder of this Python worker; its cache outlives a task that is said to use ``ENCODERS``."""
    held = kept(ENCODERS)
    if (path, spaced) not in held:
        held[path, spaced] = PieceEncoder(path, spaced)
    return held[path, spaced]
