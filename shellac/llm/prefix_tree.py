"""A prefix tree over globally ordered sets, probed for all sets above a Jaccard bound."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Probes that go down together: few at first, as the first ones join most of a group of near copies; then up to MOST, or as many as
#: fill CELLS cells of a table of probes and ranks.
FIRST, MOST, CELLS = 16, 512, 16_000_000


class PrefixTree:
    """A path-compressed trie of ascending rank sequences.

    The members are sorted, so a node covers a run of them; it holds the depths it spans, where its members lie, the
    longest of them and its children.
    """

    def __init__(self, sequences: Sequence[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: sequences[i].tolist())
        self.seqs = [sequences[i] for i in self.order]
        self.lengths = np.array([len(s) for s in self.seqs], np.int64)
        shared = [self._shared(a, b) for a, b in zip(self.seqs, self.seqs[1:])]
        self.nodes: list[tuple[int, int, int, int, int, list[int]]] = []
        self.roots = self._build(0, len(self.seqs), 0, np.array(shared, np.int64))

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        k = min(len(a), len(b))
        differ = a[:k] != b[:k]
        at = int(differ.argmax()) if k else 0
        return at if k and differ[at] else k

    def _build(self, lo: int, hi: int, depth: int, shared: np.ndarray) -> list[int]:
        """Nodes of the members lo..hi, which share their first ``depth`` ranks; worked off with a list, not by recursion."""
        roots: list[int] = []
        open_ = [(lo, hi, depth, roots)]
        while open_:
            lo, hi, depth, into = open_.pop()
            cuts = [lo, *(lo + 1 + np.flatnonzero(shared[lo : hi - 1] <= depth)).tolist(), hi] if hi > lo else []
            for a, b in zip(cuts, cuts[1:]):
                end = int(shared[a : b - 1].min()) if b - a > 1 else len(self.seqs[a])
                children: list[int] = []
                into.append(len(self.nodes))
                lengths = self.lengths[a:b]
                self.nodes.append((depth, end, a, b, int(lengths.max()), children))
                rest = a + int((lengths == end).sum())  # members that end here sort before the longer ones
                if rest < b:
                    open_.append((rest, b, end, children))
        return roots

    def probe(self, marked: np.ndarray, sizes: np.ndarray, all_sizes: np.ndarray, percent: int, labels: np.ndarray | None, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Places in sorted order with the probes whose Jaccard is at least ``percent`` / 100, all probes going down together.

        ``marked`` tells for each probe and rank whether the probe has it; ``sizes`` and ``all_sizes`` are the whole sizes of probes
        and members, of which only shared ranks are in the tree. Overlaps are counted once for all members below a node, by its
        runs of consecutive ranks. A probe leaves a subtree when its overlap so far and what is left of it or of the longest
        member can't reach the bound of the smallest member there, or when ``labels``, if given, puts all members there with its
        ``own`` already.
        """
        total = 100 + percent
        passed = np.zeros((len(marked), marked.shape[1] + 1), np.int32)  # ranks of the probe below each rank
        np.cumsum(marked, axis=1, dtype=np.int32, out=passed[:, 1:])
        have = passed[:, -1]
        changes = None if labels is None else np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        everyone = np.arange(len(marked))
        open_ = [(r, everyone, np.zeros(len(marked), np.int64)) for r in self.roots]
        while open_:
            at, active, overlap = open_.pop()
            start, end, lo, hi, longest, children = self.nodes[at]
            if changes is not None and changes[hi - 1] == changes[lo]:
                others = own[active] != labels[lo]
                active, overlap = active[others], overlap[others]
            if end > start and len(active):
                part = self.seqs[lo][start:end]
                cuts = np.flatnonzero(part[1:] - part[:-1] != 1)
                if 2 * len(cuts) + 2 < len(part):
                    firsts, afters = part[np.concatenate([[0], cuts + 1])], part[np.concatenate([cuts, [len(part) - 1]])] + 1
                    rows = active[:, None]
                    overlap = overlap + (passed[rows, afters] - passed[rows, firsts]).sum(axis=1)
                else:
                    overlap = overlap + (marked[active, part[0]] if end - start == 1 else np.count_nonzero(marked[active[:, None], part], axis=1))
                left = have[active] - passed[active, part[-1] + 1]
            else:
                left = have[active]
            reach = total * (overlap + np.minimum(left, longest - end)) >= percent * (sizes[active] + int(all_sizes[lo:hi].min()))
            active, overlap = active[reach], overlap[reach]
            if not len(active):
                continue
            i = lo
            while i < hi and self.lengths[i] == end:
                near = active[total * overlap >= percent * (sizes[active] + all_sizes[i])]
                if len(near):
                    yield i, near
                i += 1
            open_ += [(c, active, overlap) for c in children]


def links(sets: Sequence[np.ndarray], probes: Sequence[int], members: Sequence[int], percent: int) -> list[tuple[int, int]]:
    """Links that join the same components as all pairs (probe, member) with a Jaccard of at least ``percent`` / 100.

    ``sets`` are ascending hash arrays without repeats; probes and members are places in them. Pairs that are in one
    component already may be left out. Hashes that one set alone has can't be shared and count by their number only.
    """
    return _join(sets, probes, members, percent, None)[0]


def counted_links(sets: Sequence[np.ndarray], probes: Sequence[int], members: Sequence[int], percent: int, weights: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The same, and for each set the sum of ``weights`` of all other sets that it is linked with by a pair (probe, member), in
    either place. No pair is left out of the sums; pairs aren't listed, so a group takes no more memory than its sets."""
    return _join(sets, probes, members, percent, np.asarray(weights, np.int64))


def _join(sets: Sequence[np.ndarray], probes: Sequence[int], members: Sequence[int], percent: int, weights: np.ndarray | None) -> tuple[list[tuple[int, int]], np.ndarray]:
    used = sorted({*probes, *members})
    counts = np.zeros(len(sets), np.int64)
    if len(members) == 0 or len(probes) == 0 or len(used) < 2:
        return [], counts
    tokens, inverse, held = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -held))] = np.arange(len(tokens))  # common ones first: long shared paths
    shared = int((held > 1).sum())
    ranked, at = {}, 0
    for i in used:
        own = np.sort(rank[inverse[at : at + len(sets[i])]])
        ranked[i] = own[: np.searchsorted(own, shared)]
        at += len(sets[i])
    tree = PrefixTree([ranked[i] for i in members])
    places = [members[k] for k in tree.order]
    all_sizes = np.array([len(sets[i]) for i in places], np.int64)
    is_probe, is_member = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    is_probe[list(probes)], is_member[list(members)] = True, True
    up = {i: i for i in used}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out, at, step = [], 0, FIRST
    while at < len(probes):
        some = np.array(probes[at : at + max(1, min(step, CELLS // max(1, shared)))], np.int64)
        at += len(some)
        step = min(2 * step, MOST)
        marked = np.zeros((len(some), shared), bool)
        for k, p in enumerate(some.tolist()):
            marked[k, ranked[p]] = True
        sizes = np.array([len(sets[p]) for p in some], np.int64)
        labels, own = np.array([root(i) for i in places], np.int64), np.array([root(p) for p in some.tolist()], np.int64)
        for i, near in tree.probe(marked, sizes, all_sizes, percent, labels if weights is None else None, own):
            member, hit = places[i], some[near]
            if weights is not None:
                hit = hit[hit != member]
                counts[hit] += weights[member]
                # a pair that is probed from its other end too adds to that end there
                counts[member] += weights[hit[~is_member[hit]] if is_probe[member] else hit].sum()
            for p in some[near[own[near] != labels[i]]].tolist():
                a, b = root(p), root(member)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((p, member))
    return out, counts
