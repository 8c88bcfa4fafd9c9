"""The paged source over files: stop rule, cache, and a run that breaks and goes on."""

import json

import pytest

from penstroke.sources import pages, records


@pytest.fixture
def service(tmp_path):
    """A folder whose files are the pages of a service; comments k to k + 1 are on page k."""
    folder = tmp_path / "service"
    folder.mkdir()

    def put(page, total=5, text=None):
        hits = [{"comment_text": f"<p>comment {page}-{k} &amp; more", "created_at_i": 1_600_000_000 + page, "created_at": "2020", "author": "me", "objectID": f"{page}{k}", "story_id": 1} for k in range(2)]
        (folder / f"{page}.json").write_text(text or json.dumps({"hits": hits, "page": page, "nbPages": total}))

    for page in range(5):
        put(page)
    return folder, put


def read(spark, folder, cache, **options):
    spark.dataSource.register(pages.PagedSource)
    reader = spark.read.format("pages").option("url", f"file://{folder}/{{page}}.json").option("cache", str(cache)).option("delayMs", "0").option("attempts", "2")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_one_partition_a_page_up_to_the_last(spark, service, tmp_path):
    found = read(spark, service[0], tmp_path / "cache")
    assert found.rdd.getNumPartitions() == 5 and sorted(r.page for r in found.collect()) == [0, 1, 2, 3, 4]
    comments = records.forum_comments(found.select("value")).collect()
    assert len(comments) == 10 and {r.text for r in comments if r.id == "31"} == {"comment 3-1 & more"}
    assert sorted(r.page for r in read(spark, service[0], tmp_path / "other", maxPages="2").collect()) == [0, 1]


def test_a_broken_run_goes_on(spark, service, tmp_path):
    folder, put = service
    cache = tmp_path / "cache"
    put(3, text='{"hits": [')  # cut off
    with pytest.raises(Exception, match="(?i)json|delimiter|value|Expecting"):
        read(spark, folder, cache).collect()
    kept = sorted(p.name[-11:] for p in cache.iterdir() if p.suffix == ".json")
    assert "000000.json" in kept and "000003.json" not in kept and not list(cache.glob("*.part"))
    put(3)
    for name in kept:  # what is kept is not asked for again
        (folder / f"{int(name[:6])}.json").unlink()
    assert sorted(r.page for r in read(spark, folder, cache).collect()) == [0, 1, 2, 3, 4]
    for path in folder.iterdir():
        path.unlink()
    assert records.forum_comments(read(spark, folder, cache).select("value")).count() == 10


def test_addresses_do_not_mix(spark, service, tmp_path):
    one, two = pages.PageReader({"url": "file:///a/{page}", "cache": "c"}), pages.PageReader({"url": "file:///b/{page}", "cache": "c"})
    assert one.path(1) != two.path(1) and one.path(1) != one.path(2)
    with pytest.raises(ValueError, match="page"):
        pages.PageReader({"url": "file:///a", "cache": "c"})
