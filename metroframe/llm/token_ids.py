"""Encoding of whole texts with a tokenizers file, each different piece of text once per batch and worker.

A byte-level vocabulary splits a text before every space that stands between two other characters, and a word-end
vocabulary drops white space and the case of A-Z, so the ids of a text are those of its pieces in order. Where that isn't
certain at a piece's ends, or where a text has the content of an added token, it goes through the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Different pieces kept by a worker; beyond that those not in use go. Bounds memory, changes no result.
CACHE_PIECES = 300_000
#: New pieces encoded at once: the tokenizer holds far more than their ids meanwhile.
AT_ONCE = 10_000
#: Words encoded as one text, and marks after a word that are looked up alone, if it ends with a letter up to LAST_LETTER.
TOGETHER = 200
MARKS, LAST_LETTER = ".,;:!?$%&*#", "\u024f"
#: Letters that are the same in lower case, for a pattern, and those that are not.
LETTER = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha())
LETTERS, CAPITALS = "a-z\u00df-\u00f6\u00f8-\u00ff", "A-Z\u00c0-\u00d6\u00d8-\u00de"

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells LETTER: bytes of its UTF-8 that are no visible character have one from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spelled = {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}
    return {ord(c): "".join(spelled[b] for b in c.encode()) for c in LETTER}


BYTE_LETTERS = byte_letters()


def joined_bytes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint32), one after the other, and how many each part has."""
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


class Known:
    """Pieces and their ids in flat arrays: a few dozen bytes for each, where a dictionary takes hundreds."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.pieces = pa.array([], pa.large_string())
        self.flat, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int32)

    def __iter__(self):
        return iter(self.pieces.to_pylist())

    def __len__(self) -> int:
        return len(self.pieces)

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of pieces stands, or -1."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy()

    def hold(self, pieces: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.flat, self.lengths = np.append(self.flat, flat), np.append(self.lengths, lengths.astype(np.int32))

    def keep(self, which: np.ndarray) -> None:
        """Only these places stay."""
        lengths = self.lengths[which]
        begin = (np.cumsum(self.lengths, dtype=np.int64) - self.lengths)[which]
        self.flat = self.flat[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        self.pieces, self.lengths = self.pieces.take(pa.array(which)), lengths

    def ids(self, pieces: pa.Array, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids held, and where those of each of pieces (different ones) begin there and how many they are. make: ids and lengths of pieces not met before."""
        at = self.places(pieces).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(self) + len(new) > self.most:
            self.keep(at[at >= 0])
            at[at >= 0] = np.arange(len(self))
        at[new] = len(self) + np.arange(len(new))
        if len(new):
            fresh = pieces.take(pa.array(new))
            self.hold(fresh, *make(fresh))
        return self.flat, (np.cumsum(self.lengths, dtype=np.int64) - self.lengths)[at], self.lengths[at].astype(np.int64)


class Encoder:
    """path: a tokenizers file. spaced: white space is part of the tokens (byte level), else it and the case of A-Z are dropped."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.known = Known(CACHE_PIECES)
        self.joined = Known(CACHE_PIECES // 10)  # the same for pieces without a space before them
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether marks may be parted from letters before them: no added token ends with them.
        self.parts = not any(t.endswith(tuple(MARKS)) for t in self.added)
        #: Ids that begin a word (byte level) or end one: they part the ids of words that are encoded together.
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("\u0120") if spaced else token.endswith("</w>")

        #: The same model without what a text goes through before it, which only spells words of these letters in bytes.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = "".join(c for c in LETTER if spaced or c == c.lower())
        self.letters = f"^[{LETTERS}{CAPITALS if spaced else ''}]+$"
        probe = [letters[i:] + letters[:i] for i in range(len(letters))] + [a + b for a in letters for b in letters]
        same = self.bare.encode_batch_fast([self._plain(" ".join(probe))], add_special_tokens=False)[0].ids == joined_bytes(self._whole([self._spell(w) for w in probe]))[0].tolist()
        self.bare = self.bare if same else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters alone, many at a time, and how many each has. plain: of the letters that the bare model takes."""
        made, spell = (self.bare, self._plain) if plain else (self.tokenizer, self._spell)
        flat, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(words), TOGETHER), len(words)], pa.int32()), words)
        texts = pc.binary_join(groups, pa.scalar(" ", pa.large_string())).to_pylist() if len(words) else []
        for i in range(0, len(texts), AT_ONCE // TOGETHER):
            some = texts[i : i + AT_ONCE // TOGETHER]
            for text, e in zip(some, made.encode_batch_fast([spell(t) for t in some], add_special_tokens=False)):
                ids, n = np.array(e.ids, np.uint32), text.count(" ") + 1
                edges = np.flatnonzero(self.edge[ids])
                edges = np.append(edges, len(ids)) if self.spaced else np.append(0, edges + 1)
                if len(edges) != n + 1 or edges[0] or edges[-1] != len(ids):
                    ids, each = joined_bytes(self._whole([self._spell(w) for w in text.split(" ")]))
                else:
                    each = np.diff(edges)
                flat.append(ids)
                lengths.append(each)
        return np.concatenate(flat), np.concatenate(lengths)

    def _spell(self, piece: str) -> str:
        return " " + piece if self.spaced else piece

    def _plain(self, words: str) -> str:
        """Words of letters, parted by spaces, as the model has them."""
        words = words if words.isascii() else words.translate(BYTE_LETTERS)
        return "\u0120" + words.replace(" ", " \u0120") if self.spaced else words

    def _safe(self, piece: str) -> bool:
        """Whether a text may be parted at the ends of a piece, where white space is part of the tokens."""
        return piece != "" and piece[0].isprintable() and piece[-1].isprintable()

    def _pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has. Between a letter and marks after it every vocabulary parts a text, so both are looked
        up alone, but for letters that are more than letters in lower case: the dot of a capital I with one joins the marks."""
        plain = pc.match_substring_regex(new, self.letters) if self.bare else pa.array(np.zeros(len(new), bool))
        flat, lengths = self._words(new.filter(plain), True)
        if pc.all(plain).as_py() is not False:
            return flat, lengths
        others = new.filter(pc.invert(plain)).to_pylist()
        found: dict[str, bytes] = {}
        for i in range(0, len(others), AT_ONCE):
            words, rest, made = [], [], []
            for p in others[i : i + AT_ONCE]:
                if p.isalpha():
                    words.append(p)
                    continue
                core = p.rstrip(MARKS)
                if core == p or not core.isalpha() or core[-1] > LAST_LETTER or not core.lower().isalpha():
                    rest.append(p)
                else:
                    made.append((p, core))
            words = list({*words, *(c for _, c in made)})
            raw, each = self._words(pa.array(words, pa.large_string()))
            ends = np.cumsum(each)
            found.update((w, raw[b - n : b].tobytes()) for w, b, n in zip(words, ends.tolist(), each.tolist()))
            found.update(zip(rest, self._whole([self._spell(p) for p in rest])))
            tails = list({p[len(c) :] for p, c in made})
            tails = dict(zip(tails, self._whole(tails)))
            found.update((p, found[c] + tails[p[len(c) :]]) for p, c in made)
        more, each = joined_bytes([found[p] for p in others])
        # in the order of new again
        at = np.empty(len(new), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        at[is_plain], at[~is_plain] = np.arange(len(lengths)), len(lengths) + np.arange(len(each))
        both = Known(0)
        both.pieces, both.flat, both.lengths = new, np.append(flat, more), np.append(lengths, each)
        both.keep(at)
        return both.flat, both.lengths

    def _alone(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces without a space before them."""
        new = new.to_pylist()
        return joined_bytes([ids for i in range(0, len(new), AT_ONCE) for ids in self._whole(new[i : i + AT_ONCE])])

    def _parted(self, codes: np.ndarray, found: pa.Array, at: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, int]:
        """The stream of pieces (codes of found, texts begin at at) with marks after letters, and words after the end of a line, as pieces of their own, of which there are fewer different ones.

        Where white space is part of the tokens, these have no space before them: they come last in what is found, after so many others.
        """
        found = found.cast(pa.large_string())
        letters, marks = f"[{LETTERS}{CAPITALS if self.spaced else ''}]+", f"[{re.escape(MARKS)}]"
        broken = pc.match_substring_regex(found, f"^{letters}{marks}*\\n{letters}{marks}*$")
        lines = pc.split_pattern(found.filter(broken), "\n").values  # two of each
        two = broken.to_numpy(zero_copy_only=False)
        first = pc.replace_with_mask(found, broken, lines.take(pa.array(np.arange(0, len(lines), 2))))
        second = lines.take(pa.array(np.arange(1, len(lines), 2)))
        parts = np.full((len(found), 4), -1, np.int32)  # what each of found becomes: a word, marks and the end of a line, a word, marks
        kinds, rows = [], []
        for words, at_rows, column in ((first, np.arange(len(found)), 0), (second, np.flatnonzero(two), 2)):
            marked = pc.match_substring_regex(words, f"^{letters}{marks}+$")
            kinds.append(pc.if_else(marked, pc.utf8_rtrim(words, characters=MARKS), words))
            rows.append((at_rows, column))
            has = marked.to_numpy(zero_copy_only=False)
            if column == 0:
                has = has | two
                line = pa.array(["", "\n"], found.type).take(pa.array(two[has].astype(np.int8)))
                tails = pc.utf8_ltrim(words.filter(pa.array(has)), characters=LETTER)
                tails = pc.binary_join_element_wise(tails, line, pa.scalar("", found.type))
            else:
                tails = pc.utf8_ltrim(words.filter(marked), characters=LETTER)
            kinds.append(tails)
            rows.append((at_rows[has], column + 1))
        if self.spaced:
            core, others = kinds[0].dictionary_encode(), pa.concat_arrays(kinds[1:]).dictionary_encode()
            n = len(core.dictionary)
            code = np.append(core.indices.to_numpy(), n + others.indices.to_numpy())
            pieces = pa.concat_arrays([core.dictionary, others.dictionary])
        else:
            both = pa.concat_arrays(kinds).dictionary_encode()
            code, pieces = both.indices.to_numpy(), both.dictionary
            n = len(pieces)
        begin = 0
        for at_rows, column in rows:
            parts[at_rows, column] = code[begin : begin + len(at_rows)]
            begin += len(at_rows)
        count = (parts >= 0).sum(axis=1)
        out = parts[codes].reshape(-1)
        return out[out >= 0].astype(np.int64), pieces, np.append(0, np.cumsum(count[codes]))[at], n

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts without nulls, each with the id end after it, and where each begins and the last ends."""
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        texts = texts.cast(pa.large_string())
        split = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(pc.ascii_lower(texts))
        at = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        codes, found = words.indices.to_numpy().astype(np.int64), words.dictionary
        spelled = len(found)
        if self.parts:
            codes, found, at, spelled = self._parted(codes, found, at)
        found = found.cast(pa.large_string())
        pieces = len(found)
        parts = [self.known.ids(found.slice(0, spelled), self._pieces), self.joined.ids(found.slice(spelled), self._alone)]
        unsafe = np.zeros(pieces, bool)
        if self.spaced:
            odd = np.flatnonzero(~pc.match_substring_regex(found, "^[!-~]((?s:.*)[!-~])?$").to_numpy(zero_copy_only=False))
            odd = odd[odd < spelled]  # others are parted where it is certain
            unsafe[odd] = [not self._safe(p) for p in found.take(pa.array(odd)).to_pylist()]
        for token in self.added:  # in any case: it may be matched before or after the text is lower-cased
            unsafe |= pc.match_substring(found, token, ignore_case=True).to_numpy(zero_copy_only=False)
        unsafe = unsafe[codes]
        one = np.diff(at) == 1  # the text as a whole stands in the place of its first piece, if it is the only one or parting is not certain
        whole = np.logical_or.reduceat(unsafe, at[:-1]) | one if self.spaced else np.logical_or.reduceat(unsafe, at[:-1])
        if self.spaced:  # a first piece has no space before it
            firsts = found.take(pa.array(codes[at[:-1]])).to_pylist()
        else:
            firsts = [""] * n
        for d in np.flatnonzero(whole):
            firsts[d] = texts[int(d)].as_py()
            codes[at[d] : at[d + 1]] = pieces + n
        place = np.arange(n) if self.spaced else np.flatnonzero(whole)
        codes[at[place]] = pieces + place
        first_ids, first_lengths = joined_bytes([*(self._whole(firsts) if self.spaced else self._some(firsts, whole)), b""])
        parts.append((first_ids, np.cumsum(first_lengths) - first_lengths, first_lengths))
        flat = np.concatenate([ids for ids, _, _ in parts])
        before = np.cumsum([0, *(len(ids) for ids, _, _ in parts)])
        starts = np.concatenate([s + b for (_, s, _), b in zip(parts, before)])
        lengths = np.concatenate([size for _, _, size in parts])
        own = lengths[codes]
        size = np.add.reduceat(own, at[:-1])
        offsets = np.concatenate([[0], np.cumsum(size + 1)])
        # where the ids of each text's pieces, and then its end id, stand in flat and one more
        step = np.insert(own, at[1:], 1)
        place = np.insert(starts[codes], at[1:], len(flat))
        small = np.int32 if len(flat) + offsets[-1] < 2**31 else np.int64
        index = np.repeat((place - (np.cumsum(step) - step)).astype(small), step)
        index += np.arange(len(index), dtype=small)
        return np.append(flat, np.uint32(end))[index], offsets

    def _some(self, texts: list[str], which: np.ndarray) -> list[bytes]:
        """The ids of those texts, nothing for others."""
        out = [b""] * len(texts)
        for d, ids in zip(np.flatnonzero(which), self._whole([texts[d] for d in np.flatnonzero(which)])):
            out[d] = ids
        return out


def encoder(path: str, spaced: bool) -> Encoder:
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def release() -> None:
    """Forget what this worker has encoded, before work that needs the memory."""
    for e in _encoders.values():
        e.known.clear()
        e.joined.clear()


def runs(sizes: np.ndarray, most: int):
    """Consecutive runs of items that together have at most so much (a larger item alone), as (begin, end)."""
    begin = total = 0
    for i, s in enumerate(sizes):
        if i > begin and total + s > most:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_batches(batches, path: str, spaced: bool, end: int, most: int = 4_000_000):
    """For record batches with a text (null: empty): slices of them with their ids and offsets."""
    made = encoder(path, spaced)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        for a, b in runs(sizes, most):
            texts = batch["text"].take(pa.array(np.arange(a, b)))  # a copy that begins at 0, which not all functions on slices mind
            yield (batch.slice(a, b - a), *made.encode(pc.fill_null(texts.cast(pa.large_string()), ""), end))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
