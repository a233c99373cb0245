"""Property test of the rounds of training without Spark: blocks of words, the
bucketed pair table and the runs of active pairs, in numpy as in the tasks,
must give the merges of one-at-a-time training."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bpe_reference import train_bpe_local
from wordloom.operators import bpe_rounds as br


def _trained(word_counts, vocab_size, wanted, most_runs, known):
    """Rounds as ``train_bpe`` takes them; ``known`` bounds the pairs that are
    known in order, ``most_runs`` the symbols of the runs."""
    words = [(t.encode(), n) for t, n in word_counts.items() if len(t) > 1]
    if not words:
        return [], []
    symbols = np.frombuffer(b"".join(w for w, _ in words), np.uint8).astype(np.int32)
    ends, n = np.cumsum([len(w) for w, _ in words]), np.array([c for _, c in words], np.int64)
    tokens = [bytes([b]) for b in range(256)]
    ids = {t: i for i, t in enumerate(tokens)}
    budget, merges, found = vocab_size - 7 - 256, [], []
    codes, counts = br.pair_sums(symbols, ends, n)
    while budget > 0:
        order = np.empty(len(tokens), np.int64)
        order[sorted(range(len(tokens)), key=tokens.__getitem__)] = np.arange(len(tokens))
        keep = counts >= 2
        at = br.in_order(codes[keep], counts[keep], order)
        first, numbers = codes[keep][at][:known], counts[keep][at][:known]
        if not len(first):
            break
        whole, cut, tried, want = keep.sum() <= known, False, None, wanted
        while True:
            k, least = br.choose_active(numbers, whole, want, cut)
            if k == tried and not cut and k > 1:
                cut, want = True, max(1, k // 2)
                continue
            active = np.sort(first[:k])
            start, end = br.active_runs(symbols, ends, active)
            keys, which = br.run_keys(symbols, start, end)
            if sum(map(len, keys)) // 4 <= most_runs or k == 1:
                break
            tried, want = k, max(1, k // 2)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, which, n[np.searchsorted(ends, start, "right")])
        taken, changed = br.merge_runs(zip(keys, total.tolist()), tokens, ids, budget, least)
        assert taken
        merges += [(tokens[l].hex().upper(), tokens[r].hex().upper()) for l, r, _ in taken]
        found += [c for _, _, c in taken]
        budget = vocab_size - 7 - len(tokens)
        symbols, ends, n, more, change = br.with_new_runs(symbols, ends, n, active, changed)
        codes, counts = br.added(np.concatenate([codes, more]), np.concatenate([counts, change]))
        codes, counts = codes[counts > 0], counts[counts > 0]
        if len(ends):   # the changed table equals a full count
            again = br.pair_sums(symbols, ends, n)
            assert again[0].tolist() == codes.tolist() and again[1].tolist() == counts.tolist()
    return merges, found


@settings(max_examples=400, deadline=None)
@given(seed=st.integers(0, 10 ** 9), alphabet=st.sampled_from(["ab", "aab", "abc", "abcdef", "aaaab"]),
       wanted=st.sampled_from([1, 2, 5, 1000]), most_runs=st.sampled_from([5, 30, 10 ** 6]), known=st.sampled_from([1, 4, 10 ** 6]))
def test_rounds_equal_one_at_a_time(seed, alphabet, wanted, most_runs, known):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 30))]
    counts = {}
    for _ in range(rnd.randint(1, 200)):
        w = rnd.choice(vocab)
        counts[w] = counts.get(w, 0) + 1
    size = 263 + rnd.randint(1, 60)
    ref = train_bpe_local(counts, size, 2)
    assert _trained(counts, size, wanted, most_runs, known) == (ref.merges, ref.merge_counts)


def test_first_pairs_stop_where_a_bucket_is_not_known():
    pack = lambda x: np.array(x, "<i8").tobytes()
    order = np.arange(256)
    code = lambda a, b: (a << 32) | b
    full = (pack([code(1, 2), code(3, 4)]), pack([9, 2]), b"1")
    part = (pack([code(5, 6), code(7, 8)]), pack([8, 5]), b"")
    codes, counts, whole = br.first_pairs([full, part], order)
    assert counts.tolist() == [9, 8, 5] and codes.tolist() == [code(1, 2), code(5, 6), code(7, 8)] and not whole
    assert br.first_pairs([full], order)[2]
    # level 5 may go on in the bucket that is not whole: only the pairs above it are active
    assert br.choose_active(counts, whole, 3) == (2, 8)
    assert br.choose_active(np.array([5, 5, 5]), False, 2) == (2, 6)   # a single merge may be taken
    assert br.choose_active(np.array([5, 5, 3]), True, 1) == (2, 5)


def test_equal_runs_and_pairs_are_found_without_a_step_for_each():
    """Each run of a block went through a Python loop, and each pair was sorted."""
    import sys
    rng = np.random.default_rng(5)
    symbols = np.tile(rng.integers(0, 4, 50).astype(np.int32), 400)
    start = np.arange(0, len(symbols), 4)
    end = start + rng.integers(2, 5, len(start))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "c_call" else None)
    try:
        keys, which = br.run_keys(symbols, start, end)
        br.active_runs(symbols, np.arange(4, len(symbols) + 1, 4), np.array([1, (1 << 32) | 3, 3 << 32]))
        codes, counts = br.added(np.tile(np.array([7, -3, 5], np.int64), 4000), np.ones(12000, np.int64))
    finally:
        sys.setprofile(None)
    want = [symbols[a:b].tobytes() for a, b in zip(start, end)]
    assert [keys[k] for k in which] == want and keys == list(dict.fromkeys(want))
    assert codes.tolist() == [-3, 5, 7] and counts.tolist() == [4000] * 3
    assert len(calls) < 500 < len(start)
    keys, which = br.run_keys(symbols, start[:0], end[:0])
    assert keys == [] and len(which) == 0 and len(br.added(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0
    # symbols of active pairs beyond those of the block
    assert br.active_runs(symbols[:4], np.array([4]), np.array([900 << 32 | 1]))[0].tolist() == []
