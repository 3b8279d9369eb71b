"""SentencePiece encoding by sampled segmentations, and decoding.

A text's lattice has an edge for each vocabulary piece that fits; no piece goes on from a visible character into white
space, so the lattice is a chain of units (white space and what follows it), and equal units share one sub-lattice.
Pieces have a unigram log-probability by the rank that their score states, -alpha * log(rank + 2) up to a constant: a
BPE model has ranks, not probabilities. A character without a piece becomes its UTF-8 bytes, as the library does it.

Backward sums make each edge's probability given its place exact, so they are an exact heuristic for the search:
- The largest perturbed log-probability over all segmentations is a Gumbel variable; the path that has it is sampled
  edge by edge. All paths that leave it at a step, by another edge, form a region; the region's maximum is a Gumbel
  variable of the region's mass, truncated at the value of the path.
- The best region is taken from the frontier, its path sampled, and what is left of it returned to the frontier,
  truncated again. So paths come in the order of their perturbed values: a Gumbel top-k sample without replacement.
- The best value left, kappa, gives the inclusion score of each: 1 - exp(-exp(log-probability - kappa)).
All random numbers are hashes of the row's key, the path's number and the step, so a row has the same samples wherever
it is computed. Steps of all documents of a batch are drawn together with NumPy.

Edge cases: a null or empty text has one segmentation, without pieces; a text with fewer than k segmentations gives
all of them, with inclusion 1; the character U+2581 is read as a space, as the library does; equal keys with equal texts
have equal samples; an empty table gives an empty result; very long texts, and long texts without a space, are sampled
whole in a batch of their own; columns besides id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache_of, named, release, table, whole_text

SPACE = "▁"
UNIT = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
#: Characters of documents whose steps are drawn together.
BATCH_CHARS = 250_000
#: Edges of lattices that a worker keeps (24 bytes each); one batch more may stand above.
CACHED_EDGES = 4_000_000
#: Of these, the share that the most used units take with them when the others go.
STAYING = 0.5
#: Characters of new units whose lattices are made together.
BUILD_CHARS = 30_000
#: Character classes with a column in the trie's table.
COMMON = 64


class Vocabulary:
    """Pieces of a SentencePiece model with weights, and the surface bytes of each id."""

    def __init__(self, model_file: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.weight: dict[str, tuple[float, int]] = {}
        self.byte_id, self.surface = {}, []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_id[int(name[1:-1], 16)] = i
                self.surface.append(bytes([int(name[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"")
            else:
                rank = -sp.get_score(i)
                self.weight[name] = (float((rank if rank < 1e8 else 0.0) + 2) ** -alpha, i)
                self.surface.append(name.replace(SPACE, " ").encode())
        self.byte_weight = float(n + 2) ** -alpha
        self.surfaces = np.array(self.surface, dtype=object)
        total = sum(w for w, _ in self.weight.values()) + len(self.byte_id) * self.byte_weight
        self.weight = {k: (w / total, i) for k, (w, i) in self.weight.items()}
        self.byte_weight /= total
        self.longest = max(map(len, self.weight))
        self.size = n
        # weights grow by a factor a character, which no choice at a place depends on, so that sums stay near 1
        self.scale = 20.0
        self._make_trie()

    def _make_trie(self) -> None:
        """A trie of the pieces as sorted arrays: a node and a character's class to the next node."""
        often = Counter(c for p in self.weight for c in p)
        classes = {c: i for i, c in enumerate(sorted(often, key=lambda c: (-often[c], c)))}
        self.class_of = np.full(0x110001, -1, np.int16 if len(classes) < 1 << 15 else np.int32)
        self.class_of[[ord(c) for c in classes]] = list(classes.values())
        self.class_of[ord(" ")] = classes[SPACE]
        self.n_classes = len(classes)
        step: dict[int, int] = {}
        piece, weight = [-1], [0.0]
        for name, (w, i) in self.weight.items():
            node = 0
            for c in name:
                node = step.setdefault(node * self.n_classes + classes[c], len(piece))
                if node == len(piece):
                    piece.append(-1)
                    weight.append(0.0)
            piece[node], weight[node] = i, w * self.scale ** len(name)
        self.step_key = np.array(sorted(step), np.int64)
        self.step_to = np.array([step[x] for x in self.step_key.tolist()], np.int64)
        self.first_step = np.zeros(self.n_classes + 1, np.int64)  # from the root; the last entry stands for no class
        for c in classes.values():
            self.first_step[c] = step.get(c, 0)
        self.node_piece, self.node_weight = np.array(piece, np.int32), np.array(weight)
        # for the characters that pieces have most, the step stands in a table of nodes by classes
        self.table = np.zeros((len(piece), COMMON), np.int32)
        common = self.step_key % self.n_classes < COMMON
        self.table[self.step_key[common] // self.n_classes, self.step_key[common] % self.n_classes] = self.step_to[common]

    def follow(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next node by a character's class, 0 where there is none."""
        to = self.table[node, np.minimum(c, COMMON - 1)].astype(np.int64)
        rare = np.flatnonzero(c >= COMMON)
        key = node[rare] * self.n_classes + c[rare]
        spot = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
        to[rare] = np.where(self.step_key[spot] == key, self.step_to[spot], 0)
        return to


def vocabulary(model_file: str, alpha: float) -> Vocabulary:
    kept = cache_of("pieces")
    if (model_file, alpha) not in kept:
        kept[model_file, alpha] = Vocabulary(model_file, alpha)
    return kept[model_file, alpha]


class Lattices:
    """The sub-lattices of distinct units. Places of all units are numbered in a row, each unit's end included.

    An edge into a unit's end has the next place -1. cum[e] is the running probability of a place's edges up to e,
    without bound for its last one.
    """

    def __init__(self, units: list[str], vocab: Vocabulary):
        self.size = vocab.size
        length = np.array([len(u) for u in units], np.int64)
        stop = np.cumsum(length + 1) - 1  # the end of each unit
        self.start = stop - length
        n = int(stop[-1]) + 1 if len(units) else 0
        code = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        to_end = np.repeat(stop, length + 1) - np.arange(n) if n else np.zeros(0, np.int64)
        kind = np.where(to_end > 0, vocab.class_of[code], -1)

        # pieces at all places, a character longer in each round
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        at, node = np.flatnonzero(to_end > 0), np.zeros(int((to_end > 0).sum()), np.int64)
        self.extra: list[tuple[int, ...]] = []  # the byte ids of characters without a piece
        for size in range(1, vocab.longest + 1):
            c = kind[at + size - 1]
            if size == 1:
                to = vocab.first_step[c]
                ok = to > 0
                bare = at[vocab.node_piece[to] < 0]
                for char in np.unique(code[bare]).tolist():
                    where = bare[code[bare] == char]
                    ids = tuple(vocab.byte_id[b] for b in chr(char).encode("utf-8", "surrogatepass"))
                    weight = vocab.byte_weight ** len(ids) * vocab.scale
                    found.append((where, np.full(len(where), vocab.size + len(self.extra), np.int32), np.full(len(where), weight), 1))
                    self.extra.append(ids)
            else:
                at, node, c = at[c >= 0], node[c >= 0], c[c >= 0]
                to = vocab.follow(node, c)
                ok = to > 0
            at, node = at[ok], to[ok]
            is_piece = vocab.node_piece[node] >= 0
            found.append((at[is_piece], vocab.node_piece[node[is_piece]], vocab.node_weight[node[is_piece]], size))

        # edges by place, shorter pieces first
        counts = np.zeros(n, np.int64)
        for where, *_ in found:
            counts[where] += 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        total = int(self.first[-1])
        self.id, weight, target = np.empty(total, np.int32), np.empty(total), np.empty(total, np.int64)
        fill = self.first[:-1].copy()
        for where, ids, w, size in found:
            e = fill[where]
            fill[where] += 1
            self.id[e], weight[e], target[e] = ids, w, where + size

        # backward sums, from the units' ends on; an edge's probability is final at once
        of = np.repeat(np.arange(n), counts)
        far = to_end[of]
        far = far.astype(np.int16) if far.max(initial=0) < 1 << 15 else far  # small integers are sorted by counting
        order = np.argsort(far, kind="stable")
        bounds = np.searchsorted(far[order], np.arange(1, int(length.max(initial=0)) + 2))
        back = np.ones(n)
        edge_p = np.empty(total)
        for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), 1):
            e = order[a:b]
            value = weight[e] * back[target[e]]
            places = of[e]
            head = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            sums = np.add.reduceat(value, head)
            back[places[head]] = sums
            edge_p[e] = value / np.repeat(sums, np.diff(np.concatenate([head, [len(e)]])))
            odd = places[head][(sums < 1e-100) | (sums > 1e100)]
            if len(odd):  # only ratios matter to the places before; bring those still in reach back to 1
                by = back[odd]
                for j in range(min(r, vocab.longest) + 1):
                    back[odd + j] /= by
        self.next = np.where(to_end[target] == 0, -1, target).astype(np.int32)
        self.cum = edge_p.copy()
        last = self.first[1:] - 1
        e, until = self.first[:-1][counts > 1] + 1, last[counts > 1]
        while len(e):  # place by place, so that a unit's numbers are the same in every batch
            self.cum[e] += self.cum[e - 1]
            on = e < until
            e, until = e[on] + 1, until[on]
        self.cum[last[counts > 0]] = np.inf
        self.p = edge_p

    #: What there is of each edge. Logarithms are taken of the edges of paths only.
    EDGE_COLUMNS = ("id", "next", "cum", "p")

    def log_p(self, edges: np.ndarray) -> np.ndarray:
        return np.log(self.p[edges])

    def log_rest(self, edges: np.ndarray) -> np.ndarray:
        """Of the other edges of the edges' places; an only edge has the probability 1."""
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(1 - self.p[edges], 0.0))

    def append(self, other: "Lattices") -> None:
        """Takes the other's units in behind the own ones."""
        places, edges, extra = len(self.first) - 1, int(self.first[-1]), len(self.extra)
        other.id[other.id >= self.size] += extra
        other.next[other.next >= 0] += places
        self.extra += other.extra
        self._extend("start", other.start + places)
        self._extend("first", other.first[1:] + edges)
        for name in self.EDGE_COLUMNS:
            self._extend(name, getattr(other, name))

    def keep(self, units: np.ndarray) -> None:
        """Leaves these units only, numbered as they come."""
        a, b = self.start[units], np.append(self.start[1:], len(self.first) - 1)[units]
        places, edges, n_edges = ranges(a, b - a), ranges(self.first[a], self.first[b] - self.first[a]), self.first[b] - self.first[a]
        start = np.cumsum(b - a) - (b - a)
        self.first = np.concatenate([[0], np.cumsum(self.first[places + 1] - self.first[places])])
        for name in self.EDGE_COLUMNS:
            setattr(self, name, getattr(self, name)[edges])
        self.next[self.next >= 0] += np.repeat(start - a, n_edges).astype(np.int32)[self.next >= 0]
        bare, new = np.unique(self.id[self.id >= self.size], return_inverse=True)
        self.id[self.id >= self.size] = self.size + new
        self.extra = [self.extra[i] for i in (bare - self.size).tolist()]
        self.start = start

    def _extend(self, name: str, new: np.ndarray) -> None:
        """Puts new entries behind an array, in a buffer with room for more (pages without entries take no memory)."""
        own = getattr(self, name)
        n, buffer = len(own), own if own.base is None else own.base
        if n + len(new) > len(buffer):
            buffer = np.empty(max(len(buffer) * 3 // 2, n + len(new)), own.dtype)
            buffer[:n] = own
        buffer[n : n + len(new)] = new
        setattr(self, name, buffer[: n + len(new)])

    def draw(self, places: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each place, by uniform numbers below 1."""
        e = self.first[places]
        on = np.flatnonzero(u >= self.cum[e])  # few places have many edges
        while len(on):
            e[on] += 1
            on = on[u[on] >= self.cum[e[on]]]
        return e


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, n of them, one range behind the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def units_of(text: str) -> list[str]:
    """The keys of a text's units: one of a space and a word is called by the word, others by their text."""
    if not text:
        return []
    if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [u[1:] if u[0] == " " and u[1:2] not in ("", " ", SPACE) else u for u in UNIT.findall(" " + text)]


class LatticeCache:
    """The lattices of the units that a worker met, so that later batches find them.

    Once they are many, those used most often since the last time stay and the others go: most units are met once.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.lattices = vocab, Lattices([], vocab)
        self._index([])

    def _index(self, keys: list[str]) -> None:
        self.index, self.uses = defaultdict(count(len(keys)).__next__, zip(keys, range(len(keys)), strict=True)), np.zeros(len(keys), np.int64)

    def shrink(self, edges: int) -> None:
        """Leaves the units that were used more than once, the most used ones, with so many edges at most."""
        lat, order = self.lattices, np.argsort(-self.uses, kind="stable")
        n_edges = np.diff(np.append(lat.first[lat.start], lat.first[-1]))[order]
        staying = order[(self.uses[order] > 1) & (np.cumsum(n_edges) <= edges)]
        keys = list(self.index)
        lat.keep(staying)
        self._index([keys[i] for i in staying.tolist()])

    def get(self, keys: Iterable[str], n: int, cached_edges: int) -> tuple[Lattices, np.ndarray]:
        """Lattices with the n units of these keys in them, and the units' numbers there."""
        if len(self.lattices.id) > cached_edges:
            self.shrink(int(STAYING * cached_edges))
            release()
        known = len(self.index)
        unit_of = np.fromiter(map(self.index.__getitem__, keys), np.int64, n)
        some, chars = [], 0
        for key in islice(self.index, known, None):
            some.append(key if key[0] in (" ", SPACE) else " " + key)
            chars += len(key) + 1
            if chars >= BUILD_CHARS:
                self.lattices.append(Lattices(some, self.vocab))
                some, chars = [], 0
        if some:
            self.lattices.append(Lattices(some, self.vocab))
        uses = np.bincount(unit_of, minlength=len(self.index))
        uses[:known] += self.uses
        self.uses = uses
        return self.lattices, unit_of


def uniform(seed: np.ndarray, counter: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) hashed from seeds and counters (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        if isinstance(counter, int):  # one for all
            z = seed + np.uint64((counter + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        else:
            z = counter.astype(np.uint64)
            z += np.uint64(1)
            z *= np.uint64(0x9E3779B97F4A7C15)
            z += seed
        t = z >> np.uint64(30)
        z ^= t
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= np.right_shift(z, np.uint64(27), out=t)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= np.right_shift(z, np.uint64(31), out=t)
    x = np.right_shift(z, np.uint64(11), out=t).astype(np.float64)
    x += 0.5
    x *= 1 / (1 << 53)
    return x


def unit_seeds(seeds: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A seed for each unit of a document, so that steps in a unit can be counted from 0 however long it is."""
    with np.errstate(over="ignore"):
        z = seeds + (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(29))


def truncated(mass: np.ndarray, bound: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with these log masses, given that they are below the bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(np.minimum(mass - bound, 700.0)) - np.log(u)))


@dataclass
class Path:
    """A segmentation: its edges, its perturbed value, and the frontier of regions that leave it at each step."""

    edges: np.ndarray
    value: float
    before: np.ndarray  # the log-probability before each step
    log_p: float
    region: np.ndarray  # the perturbed maximum of each step's region
    taken: dict[int, list[int]]  # edges of a step that other paths have taken


def _descend(lat: Lattices, places: np.ndarray, seeds: np.ndarray, counter: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges drawn from each place to its unit's end, unit after unit, and how many each unit has. Steps count from counter."""
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    active, at = np.arange(len(places)), places
    n = np.zeros(len(places), np.int64)
    while len(active):
        e = lat.draw(at, uniform(seeds, counter + len(rounds)))
        rounds.append((active, e))
        n[active] += 1
        at = lat.next[e].astype(np.int64)
        more = np.flatnonzero(at >= 0)
        active, at, seeds = active[more], at[more], seeds[more]
    offset = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    for r, (which, e) in enumerate(rounds):
        out[offset[which] + r] = e
    return out, n


def _paths(lat: Lattices, parts: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray, seeds: np.ndarray, number: int) -> list[Path]:
    """The paths (prefix, rest) of these perturbed values. Regions in a prefix belong to the path that this one left."""
    if not parts:
        return []
    edges = np.concatenate([x for part in parts for x in part])
    size = np.array([len(p) + len(r) for p, r in parts], np.int64)
    own = np.array([len(p) for p, _ in parts], np.int64)
    end = np.cumsum(size)
    lp, before, log_p = lat.log_p(edges), np.empty(len(edges)), []
    for a, b in zip((end - size).tolist(), end.tolist(), strict=True):
        done = np.cumsum(lp[a:b])
        before[a:b] = done - lp[a:b]
        log_p.append(float(done[-1]) if b > a else 0.0)
    rest_mass = lat.log_rest(edges)
    step, path = ranges(np.zeros(len(size), np.int64), size), np.repeat(np.arange(len(size)), size)
    open_at = np.flatnonzero((rest_mass > -np.inf) & (step >= own[path]))  # steps that other edges leave
    path = path[open_at]
    region = np.full(len(edges), -np.inf)
    counter = step[open_at].astype(np.uint64) + np.uint64(((number << 1) | 1) << 40)
    region[open_at] = truncated(before[open_at] + rest_mass[open_at], values[path], uniform(seeds[path], counter))
    return [Path(edges[a:b], value, before[a:b], x, region[a:b], {}) for a, b, value, x in zip((end - size).tolist(), end.tolist(), values.tolist(), log_p, strict=True)]


def sample_batch(texts: list[str], seeds: np.ndarray, vocab: Vocabulary, k: int, cached_edges: int = CACHED_EDGES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations: ids, log-probability, perturbed value, inclusion score."""
    found = list(map(units_of, texts))
    size = np.array([len(u) for u in found], np.int64)
    lat, unit_of = cache_of("pieces").setdefault(id(vocab), LatticeCache(vocab)).get(chain.from_iterable(found), int(size.sum()), cached_edges)
    seeds = seeds.astype(np.uint64)
    token_at = np.concatenate([[0], np.cumsum(size)])
    start = lat.start[unit_of]
    number_in_doc = np.arange(len(unit_of)) - np.repeat(token_at[:-1], size)
    unit_seed = unit_seeds(np.repeat(seeds, size), number_in_doc)

    edges, n = _descend(lat, start, unit_seed, 0)
    end_of = np.concatenate([[0], np.cumsum(n)])
    none, bounds = np.zeros(0, np.int64), list(zip(token_at[:-1].tolist(), token_at[1:].tolist(), strict=True))
    firsts = -np.log(-np.log(uniform(seeds, 1 << 62)))
    paths = [[p] for p in _paths(lat, [(none, edges[end_of[a] : end_of[b]]) for a, b in bounds], firsts, seeds, 0)]
    unit_ends = [[end_of[a : b + 1] - end_of[a]] for a, b in bounds]  # of each path: the steps before each unit
    kappa = [-np.inf] * len(texts)

    for number in range(1, k + 1):
        chosen = []  # (document, path, step)
        for d, own in enumerate(paths):
            if len(own) < number:
                continue
            tops = [p.region.max() if len(p.region) else -np.inf for p in own]
            j = int(np.argmax(tops))
            kappa[d] = float(tops[j])
            if number < k and kappa[d] > -np.inf:
                chosen.append((d, j, int(own[j].region.argmax())))
        if not chosen or number == k:
            break
        at, seed, span, heads = [], [], [], []
        for d, j, i in chosen:
            path = paths[d][j]
            # the region: the same steps before i, and none of the edges taken there
            e0 = int(path.edges[i])
            place = int(np.searchsorted(lat.first, e0, side="right")) - 1
            options = np.arange(lat.first[place], lat.first[place + 1])
            gone = path.taken.setdefault(i, [e0])
            options = np.array([e for e in options.tolist() if e not in gone], np.int64)
            p = np.exp(lat.log_p(options))
            u2 = uniform(np.broadcast_to(seeds[d], 2), np.array([0, 1], np.uint64) + np.uint64((number << 42) | (1 << 61)))
            e = int(options[min(len(options) - 1, int(np.searchsorted(np.cumsum(p), u2[0] * p.sum(), side="right")))])
            gone.append(e)
            value = float(path.region[i])
            left = float(p[options != e].sum())
            mass = path.before[i] + np.log(left) if len(options) > 1 and left > 0 else -np.inf
            path.region[i] = truncated(np.array([mass]), value, u2[1:])[0]
            ends = unit_ends[d][j]
            t = int(np.searchsorted(ends, i, side="right")) - 1  # the unit of step i
            follow = int(lat.next[e])
            a, b = token_at[d] + t + 1, token_at[d + 1]
            places = ([follow] if follow >= 0 else []) + [start[a:b]]
            places = np.concatenate([np.atleast_1d(x) for x in places]).astype(np.int64)
            at.append(places)
            seed.append(unit_seed[a - (follow >= 0) : b])
            span.append(len(places))
            heads.append((e, value, t, follow >= 0))
        drawn, n = _descend(lat, np.concatenate(at), np.concatenate(seed), (number + 1) << 42)
        end = np.concatenate([[0], np.cumsum(n)])
        token, parts = 0, []
        for (d, j, i), (e, value, t, inside), m in zip(chosen, heads, span, strict=True):
            rest = drawn[end[token] : end[token + m]]
            counts = n[token : token + m]
            token += m
            parent = paths[d][j]
            parts.append((np.append(parent.edges[:i], e), rest))
            ends = unit_ends[d][j][: t + 1]
            stops = i + 1 + np.cumsum(counts) if inside else i + 1 + np.concatenate([[0], np.cumsum(counts)])
            unit_ends[d].append(np.concatenate([ends, stops]))
        new = _paths(lat, parts, np.array([value for _, value, *_ in heads]), seeds[[d for d, *_ in chosen]], number)
        for (d, *_), path in zip(chosen, new, strict=True):
            paths[d].append(path)

    out = []
    for d, own in enumerate(paths):
        samples = []
        for p in own:
            ids = lat.id[p.edges]
            if len(ids) and ids.max() >= vocab.size:
                bare = np.flatnonzero(ids >= vocab.size)  # characters to be written as their bytes
                spelt = [lat.extra[i] for i in (ids[bare] - vocab.size).tolist()]
                times = np.ones(len(ids), np.int64)
                times[bare] = [len(x) for x in spelt]
                ids = np.repeat(ids, times)
                ids[ids >= vocab.size] = list(chain.from_iterable(spelt))
            inclusion = 1.0 if kappa[d] == -np.inf else float(-np.expm1(-np.exp(min(p.log_p - kappa[d], 700.0))))
            samples.append((ids, p.log_p, p.value, inclusion))
        out.append(samples)
    return out


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ids: their surfaces joined, without the space that encoding puts in front."""
    data = b"".join(vocab.surfaces[ids].tolist())
    return data[data[:1] == b" " :].decode("utf-8", "replace")


def sampled_segmentations(docs: DataFrame, model_file: str, k: int = 2, alpha: float = 1.0, seed: int = 42, with_ids: bool = True, cached_edges: int = CACHED_EDGES, batch_chars: int = BATCH_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, sample, n_pieces, log_prob, perturbed, inclusion, ids_crc32, round_trip, ids) for each sample.

    sample counts from 0 in the order of the perturbed values; ids_crc32 is that of the ids as little-endian unsigned
    32-bit integers; round_trip: decoding gives the text again; ids are null unless asked for. cached_edges bounds the lattices
    that a worker keeps between batches, batch_chars the texts whose steps are drawn together: more take memory and save
    time; the samples are the same. An id column of the name of another result column is an error.
    """
    fields = [("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.field("element", pa.int32())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file, alpha)
        for whole in batches:
            lengths, row_seeds = pc.utf8_length(whole.column(2)).to_pylist(), whole.column(1).to_numpy()
            at = 0
            while at < len(lengths):
                end, chars = at, 0
                while end < len(lengths) and (end == at or chars + lengths[end] <= batch_chars):
                    chars += lengths[end]
                    end += 1
                rows, which = [], []
                texts = whole.column(2).slice(at, end - at).to_pylist()  # the others stay bytes
                for d, (text, samples) in enumerate(zip(texts, sample_batch(texts, row_seeds[at:end], vocab, k, cached_edges), strict=True)):
                    for s, (ids, log_p, value, inclusion) in enumerate(samples):
                        which.append(at + d)
                        back = decode(ids, vocab) == text.replace(SPACE, " ")
                        rows.append((s, len(ids), log_p, value, inclusion, zlib.crc32(ids.astype("<u4").tobytes()), back, ids if with_ids else None))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(which)), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], names=[id_col, *(n for n, _ in fields)])
                at = end
        release()  # a worker without a task holds its lattices, but not what batches left free between them

    if id_col.lower() in {n for n, _ in fields}:
        raise ValueError(f"the result has a column {id_col} of its own; rename the id column")
    id_type = docs.schema[id_col].dataType.simpleString()
    quoted = id_col.replace("`", "``")
    schema = f"`{quoted}` {id_type}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, round_trip boolean, ids array<int>"
    return docs.select(named(id_col), F.xxhash64(F.lit(seed), named(id_col)).alias("seed"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text of documents with their ids, checked by decoding."""
    import public_tokenizers

    return sampled_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
