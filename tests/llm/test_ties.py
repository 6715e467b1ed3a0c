"""N-best segmentation where very many paths tie."""

from __future__ import annotations

import random
import time

import pytest

pytest.importorskip("ragstone.llm")

import public_tokenizers  # noqa: E402

from ragstone.llm import segmentation  # noqa: E402
from ragstone.llm.pieces import SPACE, parts  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return segmentation.Lattice(PIECES)


def all_paths(lattice, text):
    """(score, cuts) of every path, by extending them piece by piece."""
    into = lattice.arcs(text)
    ways = [[(0.0, [])]]
    for end in range(1, len(text) + 1):
        ways.append([(s + score, [*cuts, text[start:end]]) for start, score in into[end] for s, cuts in ways[start]])
    return ways[-1]


@pytest.mark.parametrize("run", ["-", " ", "a", "=", "ab", "_", "*", "日", ". ", "\t", SPACE])
@pytest.mark.parametrize("length", [399, 400, 20_000])
def test_runs_are_quick(own, run, length):
    text = (run * length)[:length]
    own.best.drop()
    own.lists.drop()
    began = time.process_time()
    ways, same = own.encode_checked(text)
    assert time.process_time() - began < 5  # it takes well under one; the machine may be busy
    assert len(ways) == (1 if run in "日\t" else 4)  # these two have no longer piece
    assert [s for s, _ in ways] == sorted((s for s, _ in ways), reverse=True)
    if run != SPACE:  # the mark itself comes back as a space
        assert same and all(own.decode(ids) == text for _, ids in ways)
    assert len({ids for _, ids in ways}) == len(ways)
    assert own.encode(text, 1)[0] == ways[0]


def test_ties_against_all_paths(own):
    r = random.Random(6)
    for _ in range(250):
        text = "".join(r.choice(["-", "--", "a", "aa", "=", "an", "the"]) for _ in range(r.randint(1, 9)))[:14]
        want = sorted((s for s, _ in all_paths(own, text)), reverse=True)
        got = own.nbest(text, 4)
        assert [s for s, _ in got] == want[:4] and len({tuple(c) for _, c in got}) == len(got)
        assert all(any(s == t and cuts == c for t, c in all_paths(own, text)) for s, cuts in got)
        # of the best paths that with the longest pieces at its end, by both searches
        best = min((tuple(-len(x) for x in reversed(c)), c) for s, c in all_paths(own, text) if s == want[0])[1]
        assert got[0][1] == best
        assert own._best(" " + text)[0] == own.ids(0, best) and parts(" " + text) == (0, text)


def test_scores_that_tie_up_to_rounding(own):
    """Scores that aren't whole numbers: sums in any order are equal all the same."""
    odd = segmentation.Lattice(PIECES)
    some = {p: -0.1 - len(p) / 3 for p in odd.pieces.scores}
    odd.pieces.scores.update(some)
    odd.pieces.heads.update(some)
    odd.pieces.round_scores(1 << 24)
    began = time.process_time()
    for text in ("-" * 3000, "ab" * 1500, "=" * 1601):
        ways = odd.nbest(text, 4)
        assert len(ways) == 4 and ways[0][0] == odd.forward(text)[1][-1]
    assert time.process_time() - began < 5


def test_segments_together_as_one_by_one(own):
    r = random.Random(12)
    keys = set()
    for _ in range(3000):
        text = "".join(r.choice("theanioe é\n日\0 --==aab😀ß_") for _ in range(r.randint(0, 60)))
        keys.update(own.pieces.segments(text))
    fresh = segmentation.Lattice(PIECES)
    fresh.learn(sorted(keys))
    known = [k for k in keys if k in fresh.best]
    assert len(known) > 0.9 * len(keys) and all(fresh.best[k] == own._best(k) for k in known)
    fresh.learn([])
