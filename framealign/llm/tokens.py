"""Token ids of whole texts by the tokenizers library, each different piece of a block of texts encoded once.

Both tokenizers split a text into pre-tokens before their merges, and no pre-token crosses a single space (or a single
line feed, which is a pre-token of its own or dropped) between two characters that aren't white space. So texts are cut
there, and the ids of the pieces are put together. The different pieces of a block of BLOCK characters are found by
dictionary encoding; the library encodes each of them: by its model alone where a piece is letters and then ASCII
punctuation (two pre-tokens), by the whole tokenizer else. A text with other white space (runs, or at an end), or in
which an added token like <|endoftext|> may stand, is encoded by the library in one go. The ids are those of
`Tokenizer.from_file(path).encode(text, add_special_tokens=False)`; tests hold both against each other.

Memory: from block to block at most KEPT pieces stay, those that a block has twice; `forget` drops them at a task's end. A
text longer than STRETCH goes through in stretches.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of texts whose pieces are encoded together, and of one stretch of a long text.
BLOCK = 8_000_000
STRETCH = 4_000_000
#: Pieces kept for the blocks that follow; when there are more, all go.
KEPT = 200_000
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Letters below this are the same letters, in lower case too, in every Unicode version.
_END = "ɐ"


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1 ... of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceEncoder:
    """Encodes texts to little-endian ids of 16 bits (32 if the vocabulary is larger)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.added_starts = sorted({c for t in self.added for c in (t[0], t[0].upper())})
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        line = self._ids("a\nb")
        #: Byte-level tokenizers keep white space, so a piece holds the space before it and line feeds have an id.
        self.keeps_space = len(line) == 3
        self.line = line[1:2] if self.keeps_space else []
        self.lower = self._ids("A") == self._ids("a")
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.space = as_bytes(" ")[0][0] if self.keeps_space else ""
        #: What the byte-level step makes of the letters beyond ASCII that the model may be asked about directly.
        self.as_bytes = {ord(c): as_bytes(c)[0][0] for c in map(chr, range(128, ord(_END))) if c.isalpha() and c.lower().isalpha() and c.lower() < _END}
        self.kept: dict[str, int] = {}
        self.kept_ids = np.empty(0, self.dtype)
        self.odd = frozenset(c for c in map(chr, range(128, ord(_END))) if c.isalpha() and ord(c) not in self.as_bytes)

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _plain(self, word: str) -> bool:
        """Whether a word is letters that the model may be asked about directly."""
        return word.isalpha() and (word.isascii() or (max(word) < _END and self.odd.isdisjoint(word)))

    def _learn(self, base: str) -> list[int] | None:
        """The ids of a piece (see `_stretches`) with no marks behind it; None if it isn't letters alone."""
        lead, word = (base[0], base[1:]) if self.keeps_space and base[:1] in ("\n", "\0") else (" ", base)
        if not word or not self._plain(word):
            return None
        if self.lower:
            word = word.lower()
        ids = [t.id for t in self.tokenize((self.space if lead == " " else "") + (word if word.isascii() else word.translate(self.as_bytes)))]
        return self.line + ids if lead == "\n" else ids

    def _other(self, key: str) -> list[int] | None:
        """The ids of any piece, by the whole tokenizer; None if they depend on what stands beside it."""
        if not self.keeps_space:
            return self._ids(key) if key else []
        lead, word = (key[0], key[1:]) if key[:1] in ("\n", "\0") else (" ", key)
        if not word or word[0].isspace() or word[-1].isspace() or "\0" in word:
            return None
        ids = self._ids(" " + word if lead == " " else word)
        return self.line + ids if lead == "\n" else ids

    def _stretches(self, text: str) -> list[str]:
        """The text with a space before each piece but the first of a stretch. A piece after a line feed starts with it, the first of a text with a null."""
        cuts, at = [], 0
        while len(text) - at > STRETCH:
            at = text.find(" ", at + STRETCH)
            if at < 0 or at + 1 == len(text):
                break
            cuts.append(at)
        out = [text[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True)]
        if not self.keeps_space:
            return [s.replace("\n", " ") for s in out]
        out = [s.replace("\n", " \n") for s in out]
        return ["\0" + out[0], *out[1:]]

    def _may_hold_added(self, text: str) -> bool:
        if any(c in text for c in self.added_starts):
            low = text.lower()
            return any(t in low for t in self.added)
        return False

    def _pieces(self, keys: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all different pieces one after the other, each one's start and size, and which depend on what stands beside them.

        count: how often each piece is there.
        """
        # words with different marks behind them are asked for once
        bases = pc.utf8_rtrim(keys, characters=_MARKS)
        found = bases.dictionary_encode()
        marks = pc.subtract(pc.binary_length(keys), pc.binary_length(bases)).to_numpy().astype(np.int64)
        at_base = found.indices.to_numpy().astype(np.int64)
        n = len(found.dictionary)
        often = np.bincount(at_base, weights=count, minlength=n) > 1
        ids: list[int] = []
        start, stop, plain = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        tokenize, space, kept, old = self.tokenize, self.space, self.kept, len(self.kept_ids)
        words = (pc.ascii_lower(found.dictionary) if self.lower else found.dictionary).to_numpy(zero_copy_only=False).tolist()
        begins: list[int] = []
        for k, base in enumerate(words):
            at = kept.get(base)
            if at is not None:  # start and size of kept ids in one number
                start[k], stop[k] = at >> 16, (at >> 16) + (at & 0xFFFF)
                begins.append(-1)
                continue
            begins.append(len(ids))
            if base.isascii() and base.isalpha():
                ids += [t.id for t in tokenize(space + base)]
            else:
                own = self._learn(base)
                if own is None:
                    plain[k] = False
                else:
                    ids += own
        new = np.array(begins, np.int64)
        fresh = np.flatnonzero(new >= 0)
        start[fresh] = new[fresh] + old
        stop[fresh] = np.r_[new[fresh][1:], len(ids)] + old
        size = stop - start
        # pieces as a base and a run of marks, both among the ids
        named = keys.to_numpy(zero_copy_only=False)
        key_start, key_size = start[at_base], size[at_base]
        run_start, run_size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        whole = np.zeros(len(keys), bool)
        runs: dict[str, tuple[int, int]] = {}
        for k in np.flatnonzero(plain[at_base] & (marks > 0)).tolist():
            run = named[k][-int(marks[k]) :]
            if run not in runs:
                own = [t.id for t in tokenize(run)]
                runs[run] = (len(ids) + old, len(own))
                ids += own
            run_start[k], run_size[k] = runs[run]
        for k in np.flatnonzero(~plain[at_base]).tolist():
            own = self._other(named[k])
            whole[k] = own is None
            key_start[k], key_size[k] = len(ids) + old, len(own or ())
            ids += own or ()
        flat = np.concatenate([self.kept_ids, np.array(ids, self.dtype)])
        both = ragged(np.stack([key_start, run_start], 1).ravel(), np.stack([key_size, run_size], 1).ravel())
        out = flat[both]
        self._keep([(words[k], start[k], size[k]) for k in fresh[often[fresh] & plain[fresh] & (size[fresh] < 1 << 16)].tolist()], flat)
        sizes = key_size + run_size
        return out, np.cumsum(sizes) - sizes, sizes, whole

    def _keep(self, pieces: list[tuple[str, int, int]], flat: np.ndarray) -> None:
        if len(self.kept) + len(pieces) > KEPT:
            self.forget()
            pieces = pieces[:KEPT]
        starts, sizes = np.array([p[1] for p in pieces], np.int64), np.array([p[2] for p in pieces], np.int64)
        at = len(self.kept_ids) + np.cumsum(sizes) - sizes
        self.kept_ids = np.concatenate([self.kept_ids, flat[ragged(starts, sizes)]])
        self.kept.update(zip((p[0] for p in pieces), (at << 16 | sizes).tolist(), strict=True))

    def forget(self) -> None:
        """Drop the kept pieces, so that a worker that waits for other tasks holds none."""
        self.kept, self.kept_ids = {}, np.empty(0, self.dtype)

    def _block(self, stretches: list[str]) -> list[np.ndarray | None]:
        """The ids of each stretch; None if the text must be encoded whole."""
        cut = pc.split_pattern(pa.array(stretches, pa.large_string()), " ")
        firsts = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        del cut
        code = coded.indices.to_numpy()
        flat, starts, sizes, whole = self._pieces(coded.dictionary, np.bincount(code, minlength=len(coded.dictionary)))
        bad = np.add.reduceat(whole[code], firsts[:-1]) > 0 if whole.any() else np.zeros(len(stretches), bool)
        out: list[np.ndarray | None] = []
        step = 1 << 16  # pieces put together at once
        at = 0
        while at < len(stretches):
            to = max(at + 1, int(np.searchsorted(firsts, firsts[at] + step, side="right")) - 1)
            part = code[firsts[at] : firsts[to]]
            size = sizes[part]
            some = flat[ragged(starts[part], size)]
            ends = np.r_[0, np.cumsum(size)][firsts[at : to + 1] - firsts[at]].tolist()
            out += [None if bad[k] else some[ends[k - at] : ends[k - at + 1]] for k in range(at, to)]
            at = to
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        parts: list[list[bytes] | None] = [[] for _ in texts]
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            for k, ids in zip(owner, self._block(held) if held else [], strict=True):
                if ids is None:
                    parts[k] = None
                elif parts[k] is not None:
                    parts[k].append(ids.tobytes())
            held.clear()
            owner.clear()

        for k, text in enumerate(texts):
            if "\0" in text or self._may_hold_added(text):
                parts[k] = None
            elif text:
                for stretch in self._stretches(text):
                    held.append(stretch)
                    owner.append(k)
                    size += len(stretch)
                    if size >= BLOCK:
                        flush()
                        size = 0
        flush()
        return [np.array(self._ids(text), self.dtype).tobytes() if p is None else b"".join(p) for p, text in zip(parts, texts, strict=True)]


def slices(column: pa.Array, characters: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column a block at a time, with the row each slice starts at; null counts as empty."""
    texts: list[str] = []
    at = size = 0
    for k, text in enumerate(t for s in range(0, len(column), 512) for t in column.slice(s, 512).to_numpy(zero_copy_only=False)):
        texts.append(text or "")
        size += len(texts[-1])
        if size >= characters:
            yield at, texts
            at, texts, size = k + 1, [], 0
    if texts:
        yield at, texts


_made: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's own encoder of a file; its vocabulary is read once."""
    if path not in _made:
        _made[path] = PieceEncoder(path)
    return _made[path]
