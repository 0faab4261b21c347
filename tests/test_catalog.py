import pytest

from storyloom.operators import catalog, facets, shelves
from storyloom.spec import FilterSpec


def found(lib, ids, **spec):
    return sorted(ids(catalog.matching(lib, FilterSpec(**spec))))


@pytest.mark.parametrize("spec, want", [
    ({}, "123"), ({"include": ("BTS",)}, "12"), ({"include": ("BTS", "Fluff")}, "1"), ({"exclude": ("Angst",)}, "13"),
    ({"include": ("Fluff",), "exclude": ("EXO",)}, "1"), ({"rating": ("Explicit",)}, "13"), ({"complete": False}, "2"),
    ({"language": "fr"}, "3"), ({"words_min": 4000, "words_max": 60000}, "23"), ({"chapters_max": 5}, "13"),
    ({"state": "reading"}, "1"), ({"state": "later"}, "3"), ({"state": "unread"}, "23"), ({"state": "nonsense"}, "123"),
    ({"author": ("ANN",)}, "1"), ({"author": ("an",)}, ""), ({"author": ("ANN",), "author_ignore_case": False}, ""),
    ({"updated_after": "2021-01-01"}, "23"), ({"updated_before": "2021-01-01T23:00"}, "12"),
    ({"crossover": True}, ""), ({"crossover": False}, "123"), ({"otp": True}, ""),
])
def test_filters(shelf, ids, spec, want):
    assert "".join(found(shelf, ids, **spec)) == want


def test_list_and_count_agree(shelf, ids):
    for spec in (FilterSpec(), FilterSpec(include=("Fluff",)), FilterSpec(state="unread", complete=True)):
        assert catalog.count(shelf, spec).first().n == len(ids(catalog.works(shelf, spec)))


def test_every_work_is_in_one_state(shelf, ids):
    parts = [found(shelf, ids, state=s) for s in ("reading", "unread", "finished")]
    assert sorted(sum(parts, [])) == ["1", "2", "3"]


def test_scopes_differ_when_empty(shelf, spark, ids):
    none = spark.createDataFrame([], "work_id string")
    assert found(shelf, ids) == ["1", "2", "3"]
    assert found(shelf, ids, job_ids=none) == []
    assert found(shelf, ids, job_ids=spark.createDataFrame([("1",)], "work_id string")) == ["1"]


def test_marks_of_reading(make, ids):
    lib = make(
        works=[{"work_id": str(i), "title": "t", "chapter_count": n} for i, n in (
            (1, 5), (2, 5), (3, 5), (4, None), (5, None), (6, 2))],
        chapters=[{"work_id": "4", "number": 1}, {"work_id": "4", "number": 2}],
        reading=[{"work_id": "1", "offset": 0.4}, {"work_id": "2", "opened_at": "2026-01-01"},
                 {"work_id": "4", "chapters_read": 1}, {"work_id": "6", "chapters_read": 0, "completed_before": True}])
    assert found(lib, ids, state="reading") == ["1", "2", "4"]
    assert found(lib, ids, state="finished") == ["6"]
    assert found(lib, ids, state="unread") == ["3", "5", "6"]
    done = lib.with_(reading=make.rows("reading", [{"work_id": "4", "chapters_read": 2}]))
    assert found(done, ids, state="finished") == ["4"]


def test_placeholders_are_no_stories(make, ids):
    told = "This is part of an ongoing challenge and will be revealed soon!"
    work = lambda i, **k: {"work_id": i, "words": 0, "in_history": True, **k}
    lib = make(
        works=[work("1", authors=[], summary=told), work("2", title="Anonymous story", authors=[], summary="An actual story."),
               work("3", title="Saved before hiding", authors=[], summary=told),
               work("epub-demo", title="Imported book", authors=["Rowan"]), work("4", title="Mystery Work", authors=[]),
               work("5", authors=["Anonymous"], chapter_count=1), work("6", title="Blocked", authors=["Blocked"], hidden=True)],
        chapters=[{"work_id": "3", "number": 1, "text": "x"}])
    assert found(lib, ids) == ["2", "3", "epub-demo"]
    assert found(lib, ids, show_unrevealed=True) == ["1", "2", "3", "4", "5", "epub-demo"]


def test_authors_are_whole_names(make, ids):
    lib = make(works=[{"work_id": "1", "title": "a", "authors": ["annabel"]},
                      {"work_id": "2", "title": "b", "authors": ["pineconepickers", "tragicamente"]}])
    assert found(lib, ids, author=("ann",)) == []
    assert found(lib, ids, author=("tragicamente",)) == ["2"]


def test_sorts_put_the_unknown_last(make, ids):
    lib = make(works=[{"work_id": str(i), "title": t, "kudos": k, "words": w} for i, t, k, w in (
        (1, "beta", 5, 10), (2, "Alpha", None, None), (3, "alpha", 9, 30))])
    order = lambda s: "".join(ids(catalog.works(lib, sort=s)))
    assert order("kudos") == "312"
    assert order("title") == "231"
    assert order("words") == "312"
    assert order("shortest") == "213"
    assert order("random") == order("random")


def test_last_visits_of_every_shape(make):
    lib = make(works=[{"work_id": "1", "title": "a", "last_visited": "14 Nov 2026"},
                      {"work_id": "2", "title": "b", "last_visited": "2026-09-24T10:00:00"},
                      {"work_id": "3", "title": "c", "last_visited": "long ago"}])
    got = {r.work_id: str(r.last_read_at) for r in catalog.works(lib).collect()}
    assert got == {"1": "2026-11-14 00:00:00", "2": "2026-09-24 10:00:00", "3": "None"}


def test_facets_count_what_is_left(shelf):
    counts = lambda **s: {r.name: r.n for r in facets.tags(shelf, FilterSpec(**s), ("freeform",)).collect()}
    assert counts() == {"Fluff": 2, "Angst": 1}
    assert counts(include=("EXO",)) == {"Fluff": 1}
    ratings = facets.column(shelf, FilterSpec(rating=("Explicit",), language="en"), "rating")
    assert {r.name: r.n for r in ratings.collect()} == {"Explicit": 1, "Teen And Up Audiences": 1}
    assert {r.name for r in facets.authors(shelf, FilterSpec(author=("ann",))).collect()} == {"ann", "bee", "cee"}
    assert facets.author_count(shelf, approx=True).first().n == 3
    with pytest.raises(ValueError):
        facets.tags(shelf, FilterSpec(), ("colour",))


def test_facet_search_takes_wildcards_literally(make):
    lib = make(works=[{"work_id": "1", "title": "a"}], tags=[("1", "freeform", "100% Fluff"), ("1", "freeform", "1000 words")])
    got = facets.tags(lib, FilterSpec(), ("freeform",), 60, "100%").collect()
    assert [r.name for r in got] == ["100% Fluff"]


def test_stats_and_shelves(shelf):
    stats = facets.library_stats(shelf).first()
    assert (stats.works, stats.words, stats.finished, stats.later) == (3, 56000, 0, 1)
    rows = {(r.shelf, r.work_id) for r in shelves.all(shelf).collect()}
    assert ("reading", "1") in rows and ("later", "3") in rows and ("long", "3") in rows
    assert not any(s == "updated" for s, _ in rows)
    assert shelves.surprise(shelf, 1).first().work_id in ("2", "3")


def test_a_page_carries_its_labels(make):
    lib = make(works=[{"work_id": "1", "title": "a", "skin_css": "p{}"}],
               tags=[("1", "relationship", "B/C"), ("1", "relationship", "A/B"), ("1", "fandom", "Z")])
    row = catalog.works(lib).first()
    assert (row.relationships, row.relationship, row.fandom, row.has_skin) == ("A/B\nB/C", "A/B", "Z", True)
    assert len(catalog.works(lib).columns) == 34


def test_pages_begun_after_a_row_are_the_whole_order(make, ids):
    """Every sort, a page at a time, with ties and missing values throughout."""
    works = [{"work_id": str(i), "title": [None, "b", "B", "a"][i % 4], "authors": [["x"], ["Y"], None][i % 3], "words": [None, 5, 7][i % 3],
              "chapter_count": [2, None][i % 2], "kudos": i % 2, "published": [None, "2020-01-01", "2021-01-01"][i % 3],
              "updated": [None, "2020-05-05"][i % 2], "fetched_at": [None, "2022-01-01T00:00:00"][i % 2], "downloaded_at": [None, "2021-01-01"][i % 2 - 1],
              "hits": None, "bookmark_count": i, "visits": [None, 3][i % 2]} for i in range(11)]
    lib = make(works=works, tags=[("1", "fandom", "F"), ("1", "relationship", "A/B"), ("3", "freeform", "z")],
               reading=[{"work_id": "4", "chapter": 2, "opened_at": "2023-01-01T00:00:00"}, {"work_id": "7", "chapter": 1, "opened_at": "2023-01-01T00:00:00"}])
    for sort in ("visits", "title", "author", "updated", "published", "added", "words", "shortest", "chapters", "recent", "kudos", "bookmarks", "hits", "random"):
        whole = ids(catalog.works(lib, sort=sort, limit=None))
        assert len(whole) == 11
        got, mark = [], None
        while True:
            page = catalog.works(lib, sort=sort, limit=4, begin=mark, with_cursor=True).collect()
            got += [r.work_id for r in page]
            if len(page) < 4:
                break
            mark = page[-1].cursor
        assert got == whole, sort
    short, long_ = (catalog.works(lib, sort="words", limit=n).select("work_id", "fandom", "relationships").collect() for n in (11, catalog.SHORT + 1))
    assert short == long_


def test_a_page_does_not_shuffle_tags_and_reads_a_range(spark, tmp_path, make):
    lib = make(works=[{"work_id": str(i), "title": "t", "words": i} for i in range(20)], tags=[(str(i), "fandom", "F") for i in range(20)])
    for name in ("works", "tags"):
        getattr(lib, name).write.parquet(str(tmp_path / name))
    stored = lib.with_(**{name: spark.read.schema(getattr(lib, name).schema).parquet(str(tmp_path / name)) for name in ("works", "tags")})
    page = catalog.works(stored, sort="words", limit=5, begin=(7, "7"))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(words,7)" in plan
    joined = plan[:plan.index("Union")]
    assert "BroadcastHashJoin" in joined and [r.work_id for r in page.collect()] == ["6", "5", "4", "3", "2"]
