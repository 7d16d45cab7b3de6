"""Recall of decontamination for passages edited with words that no benchmark item has."""

import random

import pytest

from ledgerloom.llm import decontaminate


def strange():
    return "u" + "".join(random.choices("abcdefghij", k=7))


def recall(size, edit, around=30, others=()):
    """Share of 100 items whose edited passage, among words of no item, is found."""
    random.seed(size)
    items = [[f"w{random.randrange(4000)}" for _ in range(size)] for _ in range(100)]
    more = [[f"x{random.randrange(4000)}" for _ in range(n)] for n in others]
    index = decontaminate.index([(k, " ".join(words)) for k, words in enumerate(items + more)])
    found = 0
    for k, words in enumerate(items):
        edges = [[strange() for _ in range(around)] for _ in range(2)]
        text = edges[0] + edit(list(words), decontaminate.edits_allowed(size)) + edges[1]
        found += any(hit[0] == k for hit in index.find(" ".join(text)))
    return found / len(items)


def spread(words, edits):
    for k in range(edits):
        words[int((k + 0.5) * len(words) / edits)] = strange()
    return words


def anywhere(words, edits):
    for at in random.sample(range(len(words)), edits):
        words[at] = strange()
    return words


@pytest.mark.parametrize("size", [20, 40, 59])
@pytest.mark.parametrize("edit", [spread, anywhere])
def test_words_of_no_item_hide_no_passage(size, edit):
    assert recall(size, edit) >= 0.95


def front(words, edits):
    words[:edits] = [strange() for _ in range(edits)]
    return words


def lost(words, edits):
    return words[edits:]


@pytest.mark.parametrize("size", [20, 40, 59])
@pytest.mark.parametrize("edit", [front, lost])
@pytest.mark.parametrize("around", [0, 30])
def test_passages_may_have_lost_their_first_words(size, edit, around):
    assert recall(size, edit, around) >= 0.95


@pytest.mark.parametrize(("smaller", "size"), [(19, 20), (24, 26), (29, 30), (39, 41), (49, 51)])
def test_a_smaller_item_makes_no_bound_stricter(smaller, size):
    assert recall(size, spread, others=[smaller]) >= 0.95
