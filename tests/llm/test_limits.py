"""Texts made to be slow, and vectors at the ends of the range of doubles."""

import time
import tracemalloc

import numpy as np
import pytest

from shelfcast.llm import html_template, neighbours, piece_coding, secret_scan

N = 1_000_000


def pages():
    return {
        "unclosed tags": "<a " * (N // 3),
        "nested": "<div>" * (N // 5),
        "nested, then ends of others": "<div>" * (N // 10) + "</p>" * (N // 8),
        "script without end": "<script>" + "</script " * (N // 9),
        "quotes over ends": '<a " > " ' * (N // 9),
        "lists": "<ul>" * (N // 8) + "<li>" * (N // 8),
        "long class": '<div class="' + "x " * (N // 2) + '"><div class="a">t</div></div>',
    }


def bounded(run):
    """Ends within five seconds and 500 MB of Python's own memory; the tracing itself costs much of the time."""
    start = time.process_time()
    run()
    assert time.process_time() - start < 5
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500e6


@pytest.mark.parametrize("name", list(pages()))
def test_no_page_holds_a_task(name):
    page = pages()[name]
    bounded(lambda: sum(len(text) for _, _, text, _ in html_template.blocks(page)))


def test_deep_elements_keep_their_text_and_their_own_paths():
    page = "<div>" * 200 + "<p>one</p>" + "<div><p>two</p></div>" + "</div>" * 100 + "<p>three</p>"
    found = [(path, text) for path, _, text, _ in html_template.blocks(page) if text]
    assert [t for _, t in found] == ["one", "two", "three"] and len({p for p, _ in found}) == 3
    assert all(len(p) < 1000 for p, _ in found)


def test_tags_with_quotes_and_tags_that_never_end():
    said = lambda page: [t for _, _, t, _ in html_template.blocks(page) if t]
    assert said('<p title="a > b">x</p><p>y</p>') == ["x", "y"]
    assert said("<p title='>x</p><p>y</p>") == ["x", "y"]
    assert said("<p>x</p> 1 < 2 and <b") == ["x", "1 < 2 and <b"]
    assert said("<p>x</p><!-- no end <p>y") == ["x"]


TEXTS = {
    "joined": ("key=a&" * (N // 6), lambda n: n == N // 6),
    "empty": ("key=" * (N // 4), lambda n: n <= 2),
    "slashes": ("token=x/" * (N // 8), lambda n: n >= N // 8),
    "quotes": ('key="' * (N // 5), lambda n: n > 0),
    "one run": ("ab1" * (N // 3), lambda n: n == 1),
    "no digit": ("x" * N, lambda n: n == 0),
}


@pytest.mark.parametrize("name", list(TEXTS))
def test_no_text_holds_a_search_for_secrets(name):
    text, right = TEXTS[name]
    start = time.process_time()
    found = secret_scan.spans(text)
    assert time.process_time() - start < 5
    assert right(len(found)) and sum(b - a for a, b in found) <= 4 * len(text)


def test_values_end_where_the_next_name_begins():
    text = "token=abc&key=d1; password=\"S3cr3t!x\" pwd: hunter2, api_key = 'correct-horse-battery' url=x?token=y"
    values = [text[a:b] for a, b in secret_scan.spans(text)]
    assert values == ["abc", "d1", "S3cr3t!x", "hunter2", "correct-horse-battery", "y"]


def test_vectors_at_the_ends_of_the_range_take_part(spark):
    rows = [(0, [1e-200, 2e-200, 0.0]), (1, [2e-200, 4e-200, 1e-203]), (2, [1e200, 0.0, 1e200]), (3, [0.5, 1.0, 0.25]), (4, [0.0, 0.0, 0.0]), (5, [float("inf"), 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, k=2, vector="embedding").collect()
    assert len(got) == 8
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows[:4]}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for q in range(4):
        want = sorted(((-(unit[q] @ unit[i]), i) for i in unit if i != q))[:2]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in want]
        assert np.allclose([s for _, _, s in mine], [-s for s, _ in want], atol=1e-12)


def test_recall_over_many_blocks(spark, monkeypatch):
    """Cells, routing and the stop across blocks, which smaller tables never need."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    data = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(vectors, queries=lambda i: i % 50 == 0, k=5, vector="embedding").collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(set(np.argsort(-scores)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert hits / (60 * 5) >= 0.9


def test_pieces_of_a_text_without_spaces():
    """Written for the coder's memory: parts of any length must not all be remembered."""
    coder = piece_coding.Coder(piece_coding.load_vocabulary())
    text = "".join(chr(97 + i * i % 26) for i in range(300_000))
    start = time.process_time()
    ids = coder.encode(text)
    assert time.process_time() - start < 30 and coder.decode(ids) == text
