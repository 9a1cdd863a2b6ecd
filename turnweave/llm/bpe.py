"""Byte-level BPE as a bounded-lookahead streaming transducer.

Applying merges in order to a text and to a longer text can give different tokens only near
the end of the shorter one.  How near depends on the merge list alone.  Rule (a, b) can move
the first difference left, over the token a, only if the token b begins where the difference
was; for it to move once more by a later rule (c, d), the token d must begin with a, that is,
a must be on the left spine of d.  So the largest sum of left parts along chains of ever later
rules, linked through left spines, bounds the distance: :func:`sufficient_lookahead`.  A token
that ends at least so many bytes before the end of what has been read is final.

All pieces of a batch of texts go through the transducer side by side, in rounds: each reads a
window, emits the tokens that are final (all, if the piece ends there) and goes on behind them.
Equal pieces of a batch are read once.  Nothing is kept from batch to batch, so memory is that
of a batch, whatever its texts.  Ids are decoded by a state machine that holds the bytes of one
character at most.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import documents_of, over_texts

#: The pattern that cuts a text before byte-level merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens that are hashed and decoded at a time.
PART = 1 << 14
#: Bytes of text that a task encodes at once; what that takes is about 30 times as much.
BATCH = 4 << 20
#: A space between white space, or behind it at the end (in RE2's terms, and of any white space that Unicode has).
ODD_SPACE = r"[\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}] (?:[\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]|$)"
#: Letters that every version of Unicode has, and perhaps a stop or comma.
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """The lookahead in bytes for merges (left, right, result) in order, with the tokens' sizes in bytes."""
    left_of = {result: left for left, _, result in merges}
    best: dict[int, int] = {}  # left part -> longest chain that ends with a rule that has it
    for left, right, _ in merges:
        reach, at = 0, right
        while at is not None:
            reach = max(reach, best.get(at, 0))
            at = left_of.get(at)
        best[left] = max(best.get(left, 0), reach + size[left])
    return max(best.values(), default=0)


class Transducer:
    """Encodes and decodes by the merge list of one vocabulary file (byte-level, no normaliser)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.bytes_of = {i: bytes(map(letters.__getitem__, t)) for t, i in vocab.items() if all(c in letters for c in t)}
        self.base = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        triples = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {(a, b): (k, c) for k, (a, b, c) in reversed(list(enumerate(triples)))}
        self.span, self.none = max(vocab.values()) + 1, len(triples)
        by_key = sorted(((a * self.span + b, k) for (a, b), (k, _) in self.rank.items()))
        self.pair_keys, self.pair_rank = np.array([x for x, _ in by_key]), np.array([k for _, k in by_key])
        self.pair_result, self.byte_tokens = np.array([c for _, _, c in triples]), np.array(self.base)
        self.lookahead = sufficient_lookahead(triples, {i: len(b) for i, b in self.bytes_of.items()})
        self.size = np.zeros(self.span, np.int64)
        self.size[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        #: What is read of a piece in a round.
        self.window = 4 * (self.lookahead + int(self.size.max()))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        self.cut = regex.compile(PIECES)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """All merges on the bytes at hand: always the first rule of the list that applies, leftmost first."""
        tokens, rank = [self.base[b] for b in data], self.rank
        while len(tokens) > 1:
            found = min((x for x in map(rank.get, zip(tokens, tokens[1:], strict=False)) if x), default=None)
            if found is None:
                break
            out, i, last, result = [], 0, len(tokens) - 1, found[1]
            while i <= last:
                if i < last and rank.get((tokens[i], tokens[i + 1])) == found:
                    out.append(result)
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    def merge_many(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many short byte strings at once, as (tokens, the part of each), in order: in each round, every string's first rule, wherever it applies."""
        sizes = np.array(list(map(len, parts)))
        tokens, owner = self.byte_tokens[np.frombuffer(b"".join(parts), np.uint8)], np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        done_tokens, done_owner = [], []
        while len(tokens):
            keys = tokens[:-1] * self.span + tokens[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.append(np.where((self.pair_keys[at] == keys) & (owner[:-1] == owner[1:]), self.pair_rank[at], self.none), self.none)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            first = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(tokens))))
            active = first < self.none
            done_tokens.append(tokens[~active])
            done_owner.append(owner[~active])
            hit = np.flatnonzero(active & (rank == first))
            # of overlapping pairs of one token, every second from the left
            runs = np.flatnonzero(np.append(True, np.diff(hit) != 1)) if len(hit) else hit
            hit = hit[(np.arange(len(hit)) - np.repeat(runs, np.diff(np.append(runs, len(hit))))) % 2 == 0]
            tokens[hit] = self.pair_result[rank[hit]]
            active[hit + 1] = False
            tokens, owner = tokens[active], owner[active]
        owner, tokens = np.concatenate([*done_owner, owner]), np.concatenate([*done_tokens, tokens])
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def stream_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces, where each piece's begin): in rounds of one window a piece, final tokens are emitted and the rest is read again."""
        todo, at, out = np.arange(len(pieces)), np.zeros(len(pieces), np.int64), []
        sizes = np.array(list(map(len, pieces)), np.int64)
        while len(todo):
            read = [pieces[i][a : a + self.window] for i, a in zip(todo.tolist(), at[todo].tolist(), strict=True)]
            tokens, owner = self.merge_many(read)
            length = np.array(list(map(len, read)), np.int64)
            ends = np.cumsum(self.size[tokens]) - (np.cumsum(length) - length)[owner]
            whole = at[todo] + length == sizes[todo]
            final = whole[owner] | (ends <= (length - self.lookahead)[owner])
            tokens, owner = tokens[final], owner[final]
            out.append((tokens, todo[owner]))
            at[todo] += np.bincount(owner, self.size[tokens], len(todo)).astype(np.int64)
            todo = todo[~whole]
        tokens, owner = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.searchsorted(owner[order], np.arange(len(pieces) + 1))

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that comes in parts, as they become final; holds about a window at a time."""
        held = b""
        for part in data:
            for at in range(0, len(part), self.window):
                held += part[at : at + self.window]
                if len(held) < self.window:
                    continue
                tokens, _ = self.merge_many([held])
                tokens = tokens[np.cumsum(self.size[tokens]) <= len(held) - self.lookahead]
                yield from tokens.tolist()
                held = held[int(self.size[tokens].sum()) :]
        yield from self.merge_many([held])[0].tolist()

    def units(self, text: str) -> Iterator[str | int]:
        """The pieces of a text, and the ids of special tokens, whose own text is that token."""
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                yield self.special[part]
            else:
                yield from self.cut.findall(part)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        # a space goes with the word behind it, so other texts may be cut before each space
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        coded = split.flatten().dictionary_encode()
        words, code, starts = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        # letters alone are one piece with their space, and a stop or comma behind them another
        plain = pc.match_substring_regex(words, PLAIN)
        stopped = pc.and_(plain, pc.match_substring_regex(words, "[.,]$"))
        base = pc.if_else(plain, pc.if_else(stopped, pc.utf8_slice_codeunits(words, 0, -1), words), "").dictionary_encode()
        pieces = pc.binary_join_element_wise(" ", base.dictionary, "").cast(pa.binary()).to_pylist() + [b".", b","]
        plain, stopped, comma = (x.to_numpy(zero_copy_only=False) for x in (plain, stopped, pc.ends_with(words, ",")))
        counts, known = np.where(plain, 1 + stopped, 0), len(pieces)
        # other words, the beginnings of texts, which have no space, and texts that can't be cut so
        other = np.flatnonzero(~plain)
        begins, first = np.unique(code[starts[:-1]], return_inverse=True)
        code[starts[:-1]] = first + len(words)
        rest: list[list[str | int]] = [self.cut.findall(" " + w) for w in words.take(pa.array(other)).to_pylist()]
        rest += [self.cut.findall(w) for w in words.take(pa.array(begins)).to_pylist()]
        counts[other] = list(map(len, rest[: len(other)]))
        per_text, added = np.diff(starts), {}
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            added[i] = np.array([len(words) + len(rest) - len(other)])
            rest.append(list(self.units(texts[i].as_py())))
            per_text[i] = 1
        if added:
            code = np.concatenate([added.get(i, code[a:b]) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))])
        groups = np.concatenate([[0], np.cumsum(np.concatenate([counts, list(map(len, rest[len(other) :]))]))]).astype(np.int64)
        place: dict[str | int, int] = {}
        found = np.array([place.setdefault(p, known + len(place)) for c in rest for p in c], np.int64)
        flat = np.full(groups[-1], -1)
        flat[groups[:-1][: len(words)][plain]] = base.indices.to_numpy()[plain]
        flat[groups[:-1][: len(words)][stopped] + 1] = known - 2 + comma[stopped]
        flat[flat < 0] = found
        ids, at = self.stream_many(pieces + [b"" if isinstance(p, int) else p.encode() for p in place])
        own = [(k, p) for p, k in place.items() if isinstance(p, int)]
        ids = np.insert(ids, at[[k for k, _ in own]], [p for _, p in own]) if own else ids
        for k, _ in own:
            at[k + 1 :] += 1
        ids, at = gathered(ids, at, flat, groups)
        return gathered(ids, at, code, np.concatenate([[0], np.cumsum(per_text)]))

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """Text in parts: the tokens' bytes through an incremental UTF-8 state machine; broken sequences become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), PART):
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids[at : at + PART].tolist())))
        yield machine.decode(b"", True)


def gathered(flat: np.ndarray, starts: np.ndarray, wanted: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``wanted`` of flat (stretch k: starts[k]:starts[k + 1]) one behind the other, and where each group of them begins."""
    sizes = np.diff(starts)[wanted]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(ends[-1]) + np.repeat(starts[wanted] - ends[:-1], sizes)], ends[groups]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def bpe_round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode each text, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    With ``keep_ids`` also ids array<int> and decoded string.  Null or empty text: no tokens
    and an empty text.  A row's result depends on its text alone; repeated rows agree, and a
    null doc_id changes nothing.  An empty table gives no rows.
    ``path`` names a file that every executor has.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, names = transducer(path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        rows: list[tuple] = []
        ids, starts = t.encode(batch.column("text"))
        for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            own, sha, back, shown = ids[a:b], hashlib.sha256(), hashlib.sha256(), []
            for at in range(0, len(own), PART):
                sha.update((("," if at else "") + ",".join(map(t.names.__getitem__, own[at : at + PART].tolist()))).encode())
            for part in t.decode(own):
                back.update(part.encode())
                if keep_ids:
                    shown.append(part)
            rows.append((len(own), sha.hexdigest(), back.hexdigest(), own, "".join(shown)))
        columns = [[r[k] for r in rows] for k in range(5 if keep_ids else 3)]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=names[: len(columns) + 1])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return over_texts(documents_of(docs), work, schema + ", ids array<int>, decoded string" * keep_ids, BATCH)
