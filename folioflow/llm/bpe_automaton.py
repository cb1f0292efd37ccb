"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over the token alphabet that accepts exactly the correct
tokenizations. It starts as one state with a loop for every base symbol. A merge (u, v) -> w adds one gadget:

* all u-arcs are led to a copy of their target without the v-arc, as u may no longer be followed by v;
* every state with a u-arc gets a w-arc to where v led.

By induction the target of an arc depends on its token alone, so the automaton is stored as one target per token, and
per state the state it was copied from, the arc its gadget took away and the rank of that merge. Whether a state has an
arc follows from these; asked transitions are kept in a table.

Words are encoded over the automaton: the only accepted token path whose labels spell the word. Each prefix of a word has
exactly one such path, so one pass over the positions finds it, here for many words at once: tables in numpy hold the
trie of labels and the transitions asked so far. Decoding emits the arc labels.

Texts are pre-split into words by the classes of their characters, a batch of texts at once, and the ids of the words seen
are kept in a bounded table per Python worker.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import WHITE_SPACE, id_and_text, read_bytes, slices_by_bytes, text_batches

#: Entries that a worker keeps of its tables of transitions and of encoded words, and ids of these words.
TRANSITIONS, WORDS, WORD_IDS = 1_000_000, 1_000_000, 8_000_000
#: Characters of a batch, new words that are encoded at once, and letters of a word from which on words are encoded one by one.
BATCH_CHARS, NEW_WORDS, LONG_WORD = 1 << 20, 100_000, 400
#: Characters below this one are split by their classes here; of others the library's Unicode version decides.
WIDE = 0x250

_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(f"[{WHITE_SPACE}]+")
_END = "</w>"
_SPACE, _LETTER, _DIGIT, _OTHER, _WIDE = range(5)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def chunks(text: str) -> list[str]:
    """The text's parts between white space."""
    if _ODD_SPACE.search(text):  # str.split() takes these for white space, tokenizer patterns don't
        return [x for x in _SPACES.split(text) if x]
    return text.split()


@dataclass
class Automaton:
    """The compiled automaton; arrays are indexed by token or by state, state 0 is the first one."""

    target: np.ndarray  # token -> state
    left: np.ndarray  # token -> the left part of its merge, or itself
    right: np.ndarray  # token -> the right part of its merge, or itself
    rank: np.ndarray  # token -> rank of its merge, -1 for base symbols
    copied: np.ndarray  # state -> the state it is a copy of
    lost: np.ndarray  # state -> the token whose arc it lacks
    made: np.ndarray  # state -> rank of the merge whose gadget made it

    @classmethod
    def compile(cls, n_tokens: int, merges: list[tuple[int, int, int]]) -> Automaton:
        """Add one gadget for each merge (u, v, w), in order of rank."""
        target, left, right, rank = [0] * n_tokens, list(range(n_tokens)), list(range(n_tokens)), [-1] * n_tokens
        copied, lost, made = [0], [-1], [-1]
        for r, (u, v, w) in enumerate(merges):
            left[w], right[w], rank[w] = u, v, r
            q, after = target[u], target[v]
            if _has_arc(q, v, left, rank, copied, lost, made):
                copied.append(q)
                lost.append(v)
                made.append(r)
                target[u] = len(copied) - 1
            target[w] = after
        return cls(*(np.asarray(x, dtype=np.int32) for x in (target, left, right, rank, copied, lost, made)))


def _has_arc(q, t, left, rank, copied, lost, made) -> bool:
    while q:
        if lost[q] == t:
            return False
        if made[q] <= rank[t]:
            t = left[t]  # the state was there when t was made: it got a t-arc if it had an arc for t's left part
        else:
            q = copied[q]  # t was there when the state was made: it has what its original had
    return True


class Table:
    """Integers by non-negative integer keys, in open addressing with numpy."""

    def __init__(self, bits: int):
        self.shift, self.mask, self.count = 64 - bits, (1 << bits) - 1, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        slots = self._slots(keys)
        self.count += len(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of those that want one slot, the last gets it
            got = self.keys[slots] == keys
            self.values[slots[got]] = values[got]
            keys, values, slots = keys[~got], values[~got], (slots[~got] + 1) & self.mask

    def larger(self, places: int) -> Table:
        """A table with at least so many places and the same keys."""
        out, some = Table(places.bit_length()), np.flatnonzero(self.keys >= 0)
        out.put(self.keys[some], self.values[some])
        return out

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        at = np.flatnonzero((found != keys) & (found >= 0))
        while len(at):
            slots[at] = (slots[at] + 1) & self.mask
            found = self.keys[slots[at]]
            hit = found == keys[at]
            out[at[hit]] = self.values[slots[at[hit]]]
            at = at[~hit & (found >= 0)]
        return out


class Transitions:
    """Asks an automaton for arcs, for many states and tokens at once.

    A state lacks the arcs that gadgets took away on its way from the first state. They are found in an index of the
    compiled states: (token that a gadget led elsewhere, arc taken away) -> rank of its merge. A token led to a state that
    was copied before if it is at the right edge of the token asked from, and an arc was gained from its left edge. Both
    edges are walked back in the order of their merges, the later one first; an arc taken away before the edges were
    merged further is missing.
    """

    def __init__(self, automaton: Automaton):
        self.left, self.right, self.rank = automaton.left, automaton.right, automaton.rank
        merged = np.flatnonzero(self.rank >= 0)
        of_rank = np.zeros(len(merged), dtype=np.int64)
        of_rank[self.rank[merged]] = merged
        made = automaton.made[1:].astype(np.int64)
        self.pairs = Table(18)
        self.pairs.put(self.left[of_rank[made]].astype(np.int64) << 17 | automaton.lost[1:], made.astype(np.int32))
        self.token = np.zeros(len(automaton.copied), dtype=np.int64)  # a token that leads to each state
        self.token[automaton.target] = np.arange(len(automaton.target))
        self.start = np.zeros(len(automaton.copied), dtype=bool)
        self.start[0] = True
        self.lists: tuple = ()

    def have(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.ones(len(q), dtype=bool)
        at = np.flatnonzero(~self.start[q])
        u, t = self.token[q[at]], t[at].astype(np.int64)
        never = np.iinfo(np.int32).max
        until_u, until_t = np.full(len(at), never), np.full(len(at), never)
        while len(at):
            r = self.pairs.get(u << 17 | t)
            no = (r >= 0) & (r < until_u) & (r <= until_t)
            out[at[no]] = False
            ru, rt = self.rank[u], self.rank[t]
            go = ~no & ((ru >= 0) | (rt >= 0))
            at, u, t, until_u, until_t, ru, rt = at[go], u[go], t[go], until_u[go], until_t[go], ru[go], rt[go]
            later = ru > rt
            until_u, u = np.where(later, ru, until_u), np.where(later, self.right[u], u)
            until_t, t = np.where(later, until_t, rt), np.where(later, t, self.left[t])
        return out

    def has(self, q: int, t: int) -> bool:
        """The same for one state and one token."""
        if self.start[q]:
            return True
        if not self.lists:
            keys = np.flatnonzero(self.pairs.keys >= 0)
            self.lists = dict(zip(self.pairs.keys[keys].tolist(), self.pairs.values[keys].tolist(), strict=True)), self.rank.tolist(), self.left.tolist(), self.right.tolist()
        pairs, rank, left, right = self.lists
        u, until_u, until_t = int(self.token[q]), 1 << 31, 1 << 31
        while True:
            r = pairs.get(u << 17 | t, -1)
            if 0 <= r < until_u and r <= until_t:
                return False
            ru, rt = rank[u], rank[t]
            if ru < 0 and rt < 0:
                return True
            if ru > rt:
                until_u, u = ru, right[u]
            else:
                until_t, t = rt, left[t]


class Bpe:
    """Encoder and decoder of one tokenizer definition with byte symbols and word ends, built once in each worker."""

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model.get("end_of_word_suffix") != _END or pre[0]["behavior"] != "Removed" or not pre[0]["invert"]:
            raise ValueError("a BPE with word ends and a pattern of words is needed")
        self.definition, vocab = definition, model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.labels = [""] * (1 + max(*vocab.values(), *(x["id"] for x in spec["added_tokens"])))
        for s, i in vocab.items():
            self.labels[i] = s
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s, i in self.special.items():
            self.labels[i] = s
        merges = [(vocab[x], vocab[y], vocab[x + y]) for x, y in pairs]
        if len(self.labels) > 1 << 17:
            raise ValueError(f"{len(self.labels)} tokens: arcs hold a token in 17 bits")
        self.automaton = Automaton.compile(len(self.labels), merges)
        self._transitions = Transitions(self.automaton)
        self._arcs = Table(21)
        # The trie of the labels over base symbols (bytes, and bytes that end a word), as a table node, symbol -> node.
        number = {s: b for b, s in enumerate(byte_symbols())}
        children: dict[int, int] = {}
        token = [-1]
        for s, i in vocab.items():
            ends = s.endswith(_END) and s != _END
            path = [number[c] for c in (s[: -len(_END)] if ends else s)]
            path[-1] += 256 * ends
            node = 0
            for c in path:
                key = node << 9 | c
                node = children.get(key, 0)
                if not node:
                    node = children[key] = len(token)
                    token.append(-1)
            token[node] = i
        self._token = np.asarray(token, dtype=np.int64)
        self._children, self._known = children, {}
        self._trie = Table(19)
        self._trie.put(np.fromiter(children, np.int64), np.fromiter(children.values(), np.int32))
        self._pattern = regex.compile(pre[0]["pattern"]["Regex"])
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._library: Tokenizer | None = None

    def _allowed(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether the states have arcs for the tokens, from the table; what it lacks is added."""
        keys = states << 17 | tokens
        found = self._arcs.get(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            if self._arcs.count + len(new) > TRANSITIONS:
                self._arcs = Table(21)
            self._arcs.put(new, self._transitions.have(new >> 17, new & 0x1FFFF).astype(np.int32))
            found[found < 0] = self._arcs.get(keys[found < 0])
        return found > 0

    def _paths(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of pre-split words of similar lengths."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, most = len(words), int(lengths.max())
        symbols = np.zeros((most, n), dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        for j in range(most):
            on = np.flatnonzero(lengths > j)
            symbols[j, on] = flat[starts[on] + j] + 256 * (lengths[on] == j + 1)
        last = np.full((most + 1, n), -1, dtype=np.int64)
        state, came = np.zeros((most + 1, n), dtype=np.int64), np.zeros((most + 1, n), dtype=np.int64)
        for i in range(most):
            on = np.flatnonzero(lengths > i)
            node, q = np.zeros(len(on), dtype=np.int64), state[i, on]
            for j in range(i, most):
                node = self._trie.get(node << 9 | symbols[j, on]).astype(np.int64)
                go = node >= 0
                on, node, q = on[go], node[go], q[go]
                if not len(on):
                    break
                t = self._token[node]
                to = np.flatnonzero((t >= 0) & (last[j + 1, on] < 0))
                if len(to):
                    to = to[self._allowed(q[to], t[to])]
                    at, t = on[to], t[to]
                    last[j + 1, at], state[j + 1, at], came[j + 1, at] = t, self.automaton.target[t], i
                go = lengths[on] > j + 1
                on, node, q = on[go], node[go], q[go]
        at, on, steps = lengths.copy(), np.arange(n), []
        while len(on):
            step = np.full(n, -1, dtype=np.int64)
            step[on] = last[at[on], on]
            at[on] = came[at[on], on]
            steps.append(step)
            on = on[at[on] > 0]
        counts = sum((s >= 0).astype(np.int64) for s in steps).tolist()
        return [row[k - 1 :: -1] if k > 1 else row[:1] for row, k in zip(np.stack(steps, 1).tolist(), counts, strict=True)]

    def _long_path(self, word: bytes) -> list[int]:
        """Token ids of one long word: the same pass over its positions, without numpy."""
        n, children, token, target, known = len(word), self._children, self._token.tolist(), self.automaton.target.tolist(), self._known
        last, state, came = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            node, q = 0, state[i]
            for j in range(i, n):
                node = children.get(node << 9 | (word[j] + 256 * (j + 1 == n)), 0)
                if not node:
                    break
                t = token[node]
                if t >= 0 and last[j + 1] < 0:
                    arc = q << 17 | t
                    has = known.get(arc)
                    if has is None:
                        if len(known) >= TRANSITIONS:
                            known.clear()
                        has = known[arc] = self._transitions.has(q, t)
                    if has:
                        last[j + 1], state[j + 1], came[j + 1] = t, target[t], i
        out = []
        while n:
            out.append(last[n])
            n = came[n]
        return out[::-1]

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of pre-split words."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[list[int]] = [[]] * len(words)
        while order and len(words[order[-1]]) > LONG_WORD:
            i = order.pop()
            out[i] = self._long_path(words[i])
        a = 0
        while a < len(order):
            most = max(4, len(words[order[a]]) * 5 // 4)
            room = max(1, 2_000_000 // most)  # cells of the tables of positions
            b = a
            while b < len(order) and b - a < room and len(words[order[b]]) <= most:
                b += 1
            part = order[a:b]
            for i, ids in zip(part, self._paths([words[i] for i in part]), strict=True):
                out[i] = ids
            a = b
        return out

    def split(self, chunk: str) -> list[bytes | str]:
        """The words of a text without white space, as bytes, and special tokens, as their strings."""
        out: list[bytes | str] = []
        for part in self._specials.split(chunk) if "<" in chunk else (chunk,):
            if part in self.special:
                out.append(part)
            elif part and max(part) < chr(WIDE):  # composed already
                out += [w.encode() for w in self._pattern.findall((part if part.isascii() else unicodedata.normalize("NFC", part)).lower())]
            elif part:  # classes of other characters depend on the Unicode version
                if self._library is None:
                    self._library = Tokenizer.from_buffer(self.definition)
                    self._bytes = {s: b for b, s in enumerate(byte_symbols())}
                shown = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part))
                out += [bytes(self._bytes[c] for c in w) for w, _ in shown]
        return out

    def encode(self, text: str) -> list[int]:
        parts = [w for c in chunks(text) for w in self.split(c)]
        ids = iter(self.words([w for w in parts if isinstance(w, bytes)]))
        return [i for w in parts for i in ([self.special[w]] if isinstance(w, str) else next(ids))]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs taken, joined by a space (the tokenizer names no decoder)."""
        return " ".join([self.labels[i] for i in ids])


_built: dict[str, Bpe] = {}


def bpe_of(definition: bytes) -> Bpe:
    """The encoder of a definition, built once in each worker process."""
    key = hashlib.sha256(definition).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Bpe(definition)
    return _built[key]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BatchEncoder:
    """Encodes batches of texts; the ids of the words seen are kept in a bounded table, by a 64-bit hash of the word."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.kind = np.full(WIDE + 1, _WIDE, dtype=np.uint8)
        self.lower = np.zeros(WIDE + 1, dtype=np.uint32)
        for c in map(chr, range(WIDE)):
            low = c.lower()
            if len(low) == 1 and ord(low) < WIDE:
                self.lower[ord(c)] = ord(low)
                self.kind[ord(c)] = _SPACE if _SPACES.match(c) else _LETTER if regex.match(r"\p{L}", c) else _DIGIT if regex.match(r"\p{N}", c) else _OTHER
        self._clear()

    def _clear(self) -> None:
        self.table = Table(21)
        self.first, self.count, self.ids, self.used = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.table.count > WORDS or self.used > WORD_IDS:
            self._clear()
        parts, owner = [], []
        for i, t in enumerate(texts):
            at = 0
            while len(t) - at > BATCH_CHARS:  # cut at white space, which no token crosses
                found = _SPACES.search(t, at + BATCH_CHARS)
                if not found:
                    break
                parts.append(t[at : found.start()])
                owner.append(i)
                at = found.start()
            parts.append(t[at:])
            owner.append(i)
        found_ids: list[list[np.ndarray]] = [[] for _ in texts]
        split, new = [], {}
        for a, b in slices_by_bytes(parts, BATCH_CHARS):
            split.append((a, b, *self._split(parts[a:b], new)))
            if len(new) >= NEW_WORDS or b == len(parts):
                self._add(new)
                for a, b, keys, owners, slow in split:
                    for i, ids in zip(owner[a:b], self._ids(parts[a:b], keys, owners, slow), strict=True):
                        found_ids[i].append(ids)
                split, new = [], {}
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in found_ids]

    def _split(self, texts: list[str], new: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The hash and the text of each word, and the texts that are split one by one; unknown words are added to `new`."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)
        codes = np.minimum(np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32), WIDE)
        kind = self.kind[codes]
        slow = set(np.searchsorted(ends, np.flatnonzero(kind == _WIDE), side="right").tolist())
        slow |= {i for i, t in enumerate(texts) if "<|" in t}
        for i in slow:
            kind[ends[i] - sizes[i] - 1 : ends[i]] = _SPACE
        low = self.lower[codes]
        start = (kind != _SPACE) & ((kind == _DIGIT) | (kind != np.append(np.uint8(_SPACE), kind[:-1])))
        quote = np.flatnonzero(start & (low == ord("'")) & (kind == _OTHER))  # 's 't 'm 'd 're 've 'll are words
        if len(quote):
            one, two = low[np.minimum(quote + 1, len(low) - 1)], low[np.minimum(quote + 2, len(low) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[quote[short | long] + 1] = False
            after = np.concatenate([quote[short] + 2, quote[long] + 3])
            start[after] = kind[after] != _SPACE
        at = np.flatnonzero(kind != _SPACE)
        low, first = low[at], np.flatnonzero(start[at])
        lengths = np.diff(first, append=len(at))
        place = np.arange(len(at)) - np.repeat(first, lengths)
        keys = np.zeros(0, dtype=np.int64)
        if len(first):
            h = np.add.reduceat(_mix(low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), first)
            keys = (_mix(h + lengths.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        missing = np.flatnonzero(self.table.get(keys) < 0)
        some, one = np.unique(keys[missing], return_index=True)
        flat, one = low.tobytes(), missing[one]
        for k, a, n in zip(some.tolist(), first[one].tolist(), lengths[one].tolist(), strict=True):
            if k not in new:
                new[k] = flat[4 * a : 4 * (a + n)].decode("utf-32-le").encode()
        return keys, np.searchsorted(ends, at[first], side="right"), sorted(slow)

    def _ids(self, texts: list[str], keys: np.ndarray, owners: np.ndarray, slow: list[int]) -> list[np.ndarray]:
        entry = self.table.get(keys)
        n = self.count[entry]
        before = np.cumsum(n, dtype=np.int64) - n
        ids = self.ids[np.repeat(self.first[entry] - before, n) + np.arange(int(n.sum()))]
        per = np.bincount(owners, n, len(texts)).astype(np.int64)
        out = [ids[b - k : b] for b, k in zip(np.cumsum(per), per, strict=True)]
        if slow:
            words = [[w for c in chunks(texts[i]) for w in self.bpe.split(c)] for i in slow]
            distinct = list({w for ws in words for w in ws if isinstance(w, bytes)})
            known = dict(zip(distinct, self.bpe.words(distinct), strict=True))
            for i, ws in zip(slow, words, strict=True):
                out[i] = np.fromiter((k for w in ws for k in (known[w] if isinstance(w, bytes) else (self.bpe.special[w],))), np.int32)
        return out

    def _add(self, new: dict[int, bytes]) -> None:
        """Encode words and add them to the table."""
        found = self.bpe.words(list(new.values()))
        n = np.fromiter(map(len, found), np.int32, len(found))
        total, base = int(n.sum()), self.table.count
        self.first = np.concatenate([self.first[:base], self.used + np.cumsum(n) - n])
        self.count = np.concatenate([self.count[:base], n])
        self.ids = np.concatenate([self.ids[: self.used], np.fromiter((i for f in found for i in f), np.int32, total)])
        self.used += total
        if 2 * (base + len(new)) > len(self.table.keys):  # one batch may have very many new words
            self.table = self.table.larger(2 * (base + len(new)))
        self.table.put(np.fromiter(new, np.int64, len(new)), np.arange(base, base + len(new), dtype=np.int32))


_encoders: dict[str, BatchEncoder] = {}


def encoder_of(definition: bytes) -> BatchEncoder:
    """The worker's encoder of batches."""
    bpe = bpe_of(definition)
    found = _encoders.get("one")
    if found is None or found.bpe is not bpe:
        found = _encoders["one"] = BatchEncoder(bpe)
    return found


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: 0 tokens and the digest of the empty string. Rows with equal or null ids are kept, one
    result row for each. One pass without shuffle; other columns are not read.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(definition.value)
        labels = encoder.bpe.labels
        for batch, texts in text_batches(batches):
            n, shas, decoded = [], [], []
            for found in encoder.encode(texts):
                ids = found.tolist()
                n.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([labels[i] for i in ids]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
