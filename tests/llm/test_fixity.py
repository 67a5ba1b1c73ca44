import pytest

from basketlab.llm import fixity

SCHEMA = "page_id long, url string, html string, offset long, status string"


@pytest.fixture
def pages(spark, monkeypatch):
    monkeypatch.setattr(fixity, "VOLUME", 16)
    monkeypatch.setattr(fixity, "RANGE", 700)
    monkeypatch.setattr(fixity, "FANOUT", 3)

    def make(rows):
        return fixity.manifest(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))

    return make


def status(ours, theirs):
    return sorted(((r.page_id, r.status) for r in fixity.audit(ours, theirs).collect() if r.status != "intact"), key=str)


ROWS = [(k, f"http://x/{k}", "é" * (k % 50)) for k in range(200)]


def test_sound_replica(pages):
    assert status(pages(ROWS), pages(ROWS[::-1])) == []
    assert fixity.damaged_ranges(pages(ROWS), pages(ROWS)) is None


def test_damage_is_located_and_only_there(pages):
    changed = [(k, u, h[:-1] + "e" + "?" if k == 77 else h) for k, u, h in ROWS]
    assert status(pages(ROWS), pages(changed)) == [(77, "altered")]
    bad = fixity.damaged_ranges(pages(ROWS), pages(changed))
    assert [(r.volume) for r in bad.collect()] == [4]


def test_lost_added_and_longer_records(pages):
    theirs = [r for r in ROWS if r[0] != 47] + [(500, "u", "new")]
    assert status(pages(ROWS), pages(theirs)) == [(47, "missing"), (500, "extra")]
    longer = [(k, u, h + "longer" if k == 44 else h) for k, u, h in ROWS]
    assert status(pages(ROWS), pages(longer)) == [(44, "altered"), (45, "moved"), (46, "moved"), (47, "moved")]


def test_edges(pages, monkeypatch):
    monkeypatch.setattr(fixity, "FANOUT", 64)
    odd = [(None, None, None), (1, "u", None), (1, "u", None), (1, "v", "x"), (2, "w", "y" * 5000), (-3, "n", "m")]
    assert status(pages(odd), pages(odd)) == []
    assert status(pages(odd), pages(odd[:1] + odd[2:])) == [(1, "moved")]
    assert status(pages([]), pages([])) == []
    assert status(pages(odd[:1]), pages([])) == [(None, "missing")]
    assert status(pages([]), pages(odd[4:5])) == [(2, "extra")]
