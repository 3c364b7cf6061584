"""Prefix-tree set join: the in-memory core of the n-gram Jaccard join.

Sets are ascending arrays of hashes, so every set is a path in one globally ordered trie. The
sets of a block, sorted by path, are that trie: a range with a common prefix is a node. One
walk serves all probes at once. A node adds the probes' memberships of its tokens to the overlap
that its parent has counted, and a subtree is left when for no probe the overlap plus the tokens
that remain (on the path, in the probe) can reach the overlap which the smallest set below needs.
"""

from __future__ import annotations

import numpy as np


def needed(n_a, n_b, num: int, den: int):
    """Least overlap o with den * o >= num * (n_a + n_b - o)."""
    total = num * (n_a + n_b)
    return -(-total // (num + den))


def contained(x, among):
    """Marks the items of ``x`` that are in ``among``, which ascends and is not empty."""
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def join_block(sets, sizes, least, pivot, n_probe, same, emit, num=80, den=100, below=None, late=None, often=None):
    """Calls ``emit(i, probes)`` for sets ``i`` of the trie and the probe numbers that match.

    ``sets[:n_probe]`` are probes. The trie holds the sets from ``n_probe`` on or, if ``same``,
    all of them, and a pair is reported once, with the smaller number as probe. ``sizes`` are the
    sizes of the whole sets, which ``sets`` may hold in part (a bottom sketch); ``least(a, b)``
    gives the overlap that sizes ``a`` (array) and ``b`` need; ``below(a, small, big)`` the least of
    it for all ``b`` from ``small`` to ``big``, by default ``least(a, small)``, which is right where
    ``least`` does not fall as ``b`` grows. A pair counts only if ``pivot`` is its smallest common
    token: each pair is met in one block.

    Tokens in ``late`` (ascending) come after all others in the order that says which token is the
    smallest, but for pairs of which both sets are marked in ``often`` and for blocks of a late pivot,
    which hold such sets alone: there the order is that of the hashes.
    """
    below = below or (lambda a, small, big: least(a, small))
    n = len(sets)
    trie_ids = np.arange(0 if same else n_probe, n)
    if len(trie_ids) == 0 or n_probe == 0:
        return
    lens = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), lens)
    vocab, local = np.unique(flat, return_inverse=True)
    in_probe = np.bincount(local[owner < n_probe], minlength=len(vocab)) > 0
    in_trie = np.bincount(local[owner >= trie_ids[0]], minlength=len(vocab)) > 0
    if same:
        shared = np.bincount(local, minlength=len(vocab)) > 1
    else:
        shared = in_probe & in_trie
    number = np.cumsum(shared) - 1  # keeps the global order
    keep = shared[local]
    flat, owner = number[local[keep]], owner[keep]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    at = int(np.searchsorted(vocab, pivot))
    if at >= len(vocab) or vocab[at] != pivot or not shared[at]:
        return
    pivot_at = int(number[at])
    n_vocab = int(shared.sum())
    n_rare = n_early = n_vocab  # tokens from n_rare on are late, those up to n_early smaller than the pivot
    if late is not None and len(late):
        last = contained(vocab[shared], late)
        if last.any() and not last[pivot_at]:
            n_rare = int((~last).sum())
            n_early = n_rare + int(last[:pivot_at].sum())
            place = np.where(last, n_rare + np.cumsum(last) - 1, np.cumsum(~last) - 1)
            flat, pivot_at = place[flat], int(place[pivot_at])
            flat = flat[np.lexsort((flat, owner))]
    step = max(1, min(1024, (48 << 20) // max(1, n_vocab)))
    paths = [flat[bounds[i] : bounds[i + 1]] for i in range(n)]
    order = sorted(trie_ids.tolist(), key=lambda i: paths[i].astype(">u4").tobytes())
    path_len = np.array([len(paths[i]) for i in order])
    trie_size = sizes[np.array(order)]
    for lo_p in range(0, n_probe, step):
        hi_p = min(n_probe, lo_p + step)
        width = hi_p - lo_p
        member = np.zeros((n_vocab, width), np.uint8)
        f, o = flat[bounds[lo_p] : bounds[hi_p]], owner[bounds[lo_p] : bounds[hi_p]] - lo_p
        member[f, o] = 1
        probe_size, probe_len = sizes[lo_p:hi_p], np.diff(bounds[lo_p : hi_p + 1])
        probe_no = np.arange(lo_p, hi_p)
        stack = [(0, len(order), 0, np.zeros(width, np.int32), np.ones(width, bool))]
        while stack:
            lo, hi, depth, over, alive = stack.pop()
            a, b = paths[order[lo]], paths[order[hi - 1]]
            m = min(len(a), len(b))
            if lo == hi - 1:
                to = len(a)
            else:
                diff = np.flatnonzero(a[depth:m] != b[depth:m])
                to = depth + int(diff[0]) if len(diff) else m
            seg = a[depth:to]
            if len(seg):
                cut = int(np.searchsorted(seg, pivot_at))
                if cut:
                    over = over + member[seg[:cut]].sum(0, dtype=np.int32)
                if cut < len(seg):
                    if depth == 0 or a[depth - 1] < pivot_at:  # an earlier common token: that block has the pair
                        alive = alive & (over == 0)
                    over = over + member[seg[cut:]].sum(0, dtype=np.int32)
            small, big = trie_size[lo:hi].min(), trie_size[lo:hi].max()
            rest = int(path_len[lo:hi].max()) - to
            best = np.minimum(over + rest, probe_len)
            ok = alive & (best >= below(probe_size, small, big))
            if hi - lo == 1:
                i = order[lo]
                if len(a) and a[-1] >= pivot_at:
                    ny = sizes[i]
                    ok = ok & (over >= least(probe_size, ny)) & (den * np.minimum(probe_size, ny) >= num * np.maximum(probe_size, ny))
                    if same:
                        ok = ok & (probe_no < i)
                    if n_early > n_rare and often[i]:
                        early = a[np.searchsorted(a, n_rare) : np.searchsorted(a, n_early)]
                        ok = ok & ~(often[lo_p:hi_p] & member[early].any(0))
                    if ok.any():
                        emit(i, probe_no[ok])
                continue
            if not ok.any():
                continue
            ends = lo
            while ends < hi and path_len[ends] == to:  # sets that end at this node
                stack.append((ends, ends + 1, to, over, ok))
                ends += 1
            if ends < hi:
                tokens = np.array([paths[order[j]][to] for j in range(ends, hi)])
                starts = np.concatenate(([0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, [hi - ends]))
                for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    stack.append((ends + x, ends + y, to, over, ok))

