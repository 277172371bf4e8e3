"""BPE encoding and decoding over a prefix trie of distinct words.

The tokenizer file gives vocabulary, merges, the split pattern and the special tokens. White space
always separates tokens, so a text's ids are the ids of its white-space-delimited words in order, and
each distinct word needs encoding once. The distinct pieces go in sorted order, which is depth first, into
a trie that a task keeps; every new node takes, from the nodes above it, the last token of that prefix's
own encoding. The last token t of a longer prefix is the longest suffix token whose predecessor state accepts
it: BPE of the two tokens side by side is those two tokens. The tokens that are suffixes of a prefix stand in
a chain, built once from the vocabulary: the longest part of a token that ends the prefix follows from the
parent's, and each such part names the tokens that end it. So a shared prefix is encoded once for all words
below it, whatever batch they come from.

Defined cases: null text counts as empty (no ids, the hash of nothing); any text length is taken whole;
rows are independent, so ties, repeated rows and extra columns do not matter; an empty table gives none. A
tokenizer file whose normaliser or pre-tokeniser is of another shape raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import regex

#: Distinct words in each of the two generations of a task's cache, trie nodes, and token pairs that a worker keeps.
CACHE_WORDS, NODES, PAIRS = 250_000, 800_000, 1_000_000
#: The normaliser and pre-tokeniser this reader knows.
NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
#: Code points that str.split() takes for white space and Unicode does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in visible else spare))
        spare += b not in visible
    return out


def checked(spec: dict) -> str:
    """The split pattern of a tokenizer file, if its normaliser and pre-tokeniser are those that this reader follows."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in norm.get("normalizers", [])]
    cuts = pre.get("pretokenizers", [])
    if steps != NORMALIZERS or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        raise ValueError("a normaliser or pre-tokeniser of another kind")
    split, level = cuts
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        raise ValueError("a pre-tokeniser of another kind")
    return split["pattern"]["Regex"]


class TrieBPE:
    """Encoder and decoder of one tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (i, self.vocab[self.joined(a, b)]) for i, (a, b) in enumerate(merges)}
        #: token -> (rank of the merge that makes it, left part, right part)
        self.parts = {t: (r, a, b) for (a, b), (r, t) in reversed(self.rank.items())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(checked(spec))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = dict(enumerate(byte_symbols()))
        self.length = {i: len(t) for i, t in self.token.items()}
        self.name = {i: str(i) for i in self.token}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.chains()
        self.forget()

    def forget(self) -> None:
        """Drop words and trie: a worker outlives its task, and what follows may need the memory."""
        #: word -> its ids, and its tokens, joined by spaces; words of the generation before
        self.ids_of: dict[str, str] = {}
        self.tokens_of: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.plant()

    @staticmethod
    def joined(a: str, b: str) -> str:
        return a + b

    # -- which tokens may stand side by side -------------------------------------------------

    def apart(self, left: int, right: int) -> bool:
        """Does BPE leave these two tokens, side by side, as they are?

        Undo the merges of both in turn, latest first; a merge across the border that ranks before the
        later of the merges still standing there would have happened first, so the pair could not arise.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        never = 1 << 40
        limit, side = never, 0  # a merge over the border must come before limit (on a tie: not after the left one)
        while True:
            cross = self.rank.get((left, right))
            if cross is not None and (cross[0] < limit or cross[0] == limit and side == 2):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, side, left = a[0], 1, a[2]
            else:
                limit, side, right = b[0], 2, b[1]

    def alone(self, token: int) -> bool:
        """Is the token the encoding of its own symbols?"""
        known = self.whole.get(token)
        if known is None:
            part = self.parts.get(token)
            known = part is None or self.plain(self.token[token]) == [token]
            self.whole[token] = known
        return known

    def plain(self, text: str) -> list[int]:
        """Merge by merge, for checking single tokens; text may end in the end-of-word suffix."""
        body = text.removesuffix(self.suffix)
        units = [*body[:-1], body[-1] + text[len(body) :]]
        ids = [self.vocab[u] for u in units]
        while len(ids) > 1:
            best = min((self.rank[p] for p in zip(ids, ids[1:], strict=False) if p in self.rank), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                found = self.rank.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if found == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    # -- suffix tokens -----------------------------------------------------------------------

    def chains(self) -> None:
        """Number the parts of tokens (their prefixes): child by part and symbol, and the tokens that end each part.

        open_[part] and shut[part]: (token, its length) of the tokens without and with the end mark that are
        suffixes of the part, longest first; fall[part]: its longest proper suffix that is a part.
        """
        self.child: dict[int, int] = {}
        self.fall, self.open_, self.shut = [0], [()], [()]
        own: list[tuple[int, int]] = [(-1, -1)]
        depth = [0]
        above: list[tuple[int, int]] = [(0, 0)]  # parent and symbol of each part
        for text, token in self.vocab.items():
            ends = bool(self.suffix) and text.endswith(self.suffix) and text != self.suffix
            at = 0
            for ch in text.removesuffix(self.suffix) if ends else text:
                key = at << 10 | ord(ch)
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(own)
                    own.append((-1, -1))
                    depth.append(depth[at] + 1)
                    above.append((at, ord(ch)))
                at = nxt
            own[at] = (own[at][0], token) if ends else (token, own[at][1])
        n = len(own)
        self.fall, self.open_, self.shut = [0] * n, [()] * n, [()] * n
        for k in sorted(range(1, n), key=depth.__getitem__):
            parent, ch = above[k]
            low = self.step(self.fall[parent], ch) if parent else 0
            self.fall[k] = low
            for mine, chain in zip(own[k], (self.open_, self.shut), strict=True):
                chain[k] = ((mine, depth[k]), *chain[low]) if mine >= 0 else chain[low]

    def step(self, part: int, ch: int) -> int:
        """The longest part of a token that ends a text whose end was `part`, after one more symbol."""
        while True:
            nxt = self.child.get(part << 10 | ch)
            if nxt is not None:
                return nxt
            if not part:
                return 0
            part = self.fall[part]

    # -- the trie ----------------------------------------------------------------------------

    def plant(self) -> None:
        """An empty trie: child by node and symbol; each node's last token and ending part."""
        self.kids: dict[int, int] = {}
        self.last, self.part = [-1], [0]

    def last_token(self, chain: tuple, depth: int, states: list[int]) -> tuple[int, int]:
        """The last token, and its length, of a text of depth symbols; states[j] is that of its first j symbols."""
        for token, n in chain:
            if self.apart(states[depth - n], token) if n < depth else self.alone(token):
                return token, n
        raise ValueError("the vocabulary lacks a symbol")

    def learn(self, pieces: set[str]) -> dict[str, list[int]]:
        """The ids of distinct pieces (symbol strings), which go into the trie depth first."""
        if len(self.last) > NODES:
            self.plant()
        kids, last, part, length, out = self.kids, self.last, self.part, self.length, {}
        chain = self.shut if self.suffix else self.open_
        path, states, before = [0], [-1], ""
        for piece in sorted(pieces):
            k = 0
            for a, b in zip(piece, before, strict=False):
                if a != b:
                    break
                k += 1
            del path[k + 1 :], states[k + 1 :]
            node = path[k]
            for ch in map(ord, piece[k:]):
                key = node << 10 | ch
                kid = kids.get(key)
                if kid is None:
                    end = self.step(part[node], ch)
                    kid = kids[key] = len(last)
                    last.append(self.last_token(self.open_[end], len(path), states)[0])
                    part.append(end)
                node = kid
                path.append(kid)
                states.append(last[kid])
            before = piece
            token, n = self.last_token(chain[part[node]], len(piece), states)
            ids, at = [token], len(piece) - n
            while at:
                token = states[at]
                ids.append(token)
                at -= length[token]
            ids.reverse()
            out[piece] = ids
        return out

    # -- words and texts ---------------------------------------------------------------------

    def pieces_of(self, word: str) -> list[str]:
        if word.isascii():
            plain = word.lower()
            if plain.isalpha():
                return [plain]
            found = self.pattern.findall(plain)
            return found if plain.isprintable() else [p.translate(self.symbols) for p in found]  # visible bytes stand for themselves
        plain = "".join(map(str.lower, unicodedata.normalize("NFC", word)))
        return [p.encode().decode("latin-1").translate(self.symbols) for p in self.pattern.findall(plain)]

    def split(self, text: str) -> list[str]:
        return [w for w in SPACE.split(text) if w] if NOT_SPACE.search(text) else text.split()

    def learn_words(self, words: set[str], marked: bool) -> None:
        """Make ids_of and tokens_of hold each word; a full generation ages, and what is asked for again returns.

        marked: a special token's string may occur.
        """
        if len(self.ids_of) > CACHE_WORDS:
            self.older, self.ids_of, self.tokens_of = (self.ids_of, self.tokens_of), {}, {}
        new = words.difference(self.ids_of)
        ids, tokens = self.older
        back = new.intersection(ids)
        for w in back:
            self.ids_of[w], self.tokens_of[w] = ids[w], tokens[w]
        new -= back
        own = {w: self.pieces_of(w) for w in new if not (marked and self.cut.search(w))}
        # a special token's string in a word is that token; what stands around it is cut as ever
        mixed = {w: [x if x in self.special else self.pieces_of(x) for x in self.cut.split(w) if x] for w in new if w not in own}
        known = self.learn({p for ps in own.values() for p in ps} | {p for parts in mixed.values() for ps in parts if isinstance(ps, list) for p in ps})
        of = {w: known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]] for w, ps in own.items()}
        of |= {w: [i for x in parts for i in ([self.special[x]] if isinstance(x, str) else [i for p in x for i in known[p]])] for w, parts in mixed.items()}
        name, token = self.name, self.token
        for w, ids in of.items():
            self.ids_of[w] = " ".join([name[i] for i in ids])
            self.tokens_of[w] = " ".join([token[i] for i in ids])

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, ids joined by spaces, decoded text."""
        split = [self.split(t) for t in texts]
        marked = any(s in t for s in self.special for t in texts)
        self.learn_words(set().union(*split) if split else set(), marked)
        ids_of, tokens_of = self.ids_of.__getitem__, self.tokens_of.__getitem__
        for words in split:  # the pattern takes anything but white space, so every word has an id
            ids = " ".join(map(ids_of, words))
            yield ids.count(" ") + bool(ids), ids, " ".join(map(tokens_of, words))

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.encode_batch([text]))[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])


_LOADED: dict[str, TrieBPE] = {}


def encoder(path: str) -> TrieBPE:
    """One encoder for each file and worker."""
    if path not in _LOADED:
        _LOADED[path] = TrieBPE(path)
    return _LOADED[path]


def slices(column, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string or binary column of about limit bytes each; one longer row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(column_lengths(column)):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(column):
        yield start, len(column)


def column_lengths(column) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def encode_decode(df, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = True):
    """Encode and decode every whole text.

    Returns the columns of keep, n_tokens, and either ids (array<int>) and decoded, or, with digests, their
    sha256 as hex: ids as decimals joined by one space, and the decoded text in UTF-8.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from .common import name_of, with_fields

    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"

    fields = with_fields(df, keep, extra)

    def work(batches):
        enc = encoder(tokenizer)
        try:
            for batch in batches:
                for a, b in slices(batch.column("__text")):
                    yield encoded(enc, batch.slice(a, b - a))
        finally:
            enc.forget()

    def encoded(enc: TrieBPE, part):
        rows = list(enc.encode_batch([t or "" for t in part.column("__text").to_pylist()]))
        out = [part.column(k) for k in keep] + [pa.array([r[0] for r in rows], pa.int64())]
        if digests:
            out += [pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()) for k in (1, 2)]
        else:
            out += [pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(out, names=[*keep, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return df.select(*map(name_of, keep), F.col(text).alias("__text")).mapInArrow(work, fields)
