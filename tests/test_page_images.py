"""The kept table of page images, and cuts found among candidates."""

import random

import pytest
from pyspark.sql import functions as F

from newsweave.operators import images
from newsweave.plans import digest as digests
from newsweave.sources.page_images import PageImages

ARRIVAL = ["source_rank", "payload_id", "position"]
DOMAINS = ["example.org"]
PAGES = "page_id int, landed int, url string, html string, status int"


def page(name):
    return f'<html><head><meta property="og:image" content="https://cdn.test/{name}.jpg"></head></html>'


def make(spark, rows):
    return spark.createDataFrame([(*row, 200) if len(row) == 4 else row for row in rows], PAGES)


def test_pages_are_parsed_once(spark, tmp_path):
    rows = [(n, 1, f"https://example.org/{n}", page(n) if n % 3 else "") for n in range(9)]
    rows += [(20, 1, "https://other.test/x", page(20)), (21, 1, "https://example.org/21", page(21), 404)]
    kept = PageImages(spark, str(tmp_path / "kept"), ["page_id"], ["landed"], DOMAINS)
    first = make(spark, rows)
    assert kept.pages(first).count() == 0
    assert kept.extend(first) == 9
    # The same keys with other HTML: nothing is read again.
    assert kept.extend(first.withColumn("html", F.lit(page("again")))) == 0
    later = [(n, 2, f"https://example.org/{n}", page(f"new{n}")) for n in (3, 4)] + [(None, 2, "https://example.org/n", page("n"))]
    assert kept.extend(make(spark, rows + later)) == 3
    assert kept.extend(make(spark, rows + later)) == 0
    assert kept.extend(first.limit(0)) == 0
    found = images.page_images(kept.pages(first), DOMAINS, ["landed"])
    whole = images.page_images(make(spark, rows + later), DOMAINS, ["landed"])
    assert sorted(found.collect()) == sorted(whole.collect())
    assert dict(map(tuple, found.collect()))["https://example.org/3"] == "https://cdn.test/new3.jpg"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan


def test_enrichment_from_the_table(spark, make_articles, tmp_path):
    rows = make(spark, [(n, 1, f"https://example.org/{n}", page(n)) for n in range(4)])
    kept = PageImages(spark, str(tmp_path / "kept"), ["page_id"], domains=DOMAINS)
    kept.extend(rows)
    given = make_articles([{"url": f"https://example.org/{n}", "image": "own" if n == 1 else ""} for n in range(6)])
    for enrich in (images.enrich_images, images.enrich_few):
        wanted = sorted(enrich(given, rows, DOMAINS).select("url", "image", "had_image").collect())
        assert sorted(enrich(given, kept.pages(rows), DOMAINS).select("url", "image", "had_image").collect()) == wanted


def cut(articles, size, by_candidates):
    chosen = digests.newest_unique(articles, size, ARRIVAL, False, by_candidates)
    return sorted((row.url, row.position, row.published) for row in chosen.collect())


def test_candidates_whose_first_arrival_is_old(spark, make_articles):
    """Newer copies of addresses that first arrived with an old date are not in the cut."""
    old = [{"url": f"again{n}", "published": "2020-01-01"} for n in range(30)]
    new = [{"url": f"again{n}", "published": f"2025-02-{1 + n % 28:02}"} for n in range(30)]
    real = [{"url": f"real{n}", "published": f"2024-03-{1 + n:02}"} for n in range(9)]
    undated = [{"url": f"none{n}"} for n in range(5)] + [{"url": "", "published": "2026-01-01"}]
    given = make_articles(old + new + real + undated)
    for size in (1, 3, 9, 20, 100):
        assert cut(given, size, True) == cut(given, size, False)
    assert {url for url, *_ in cut(given, 3, True)} == {"real6", "real7", "real8"}
    assert cut(given, 0, True) == []


@pytest.mark.parametrize("seed", range(3))
def test_candidates_by_brute_force(spark, make_articles, seed):
    rng = random.Random(seed)
    rows = [
        {"url": f"u{rng.randrange(60)}", "published": rng.choice(["", "x", f"202{rng.randrange(3)}-0{rng.randint(1, 9)}-1{rng.randrange(3)}"])}
        for _ in range(200)
    ]
    given = make_articles(rows)
    first = {}
    for place, row in enumerate(rows):
        first.setdefault(row["url"], (row["published"] if row["published"] not in ("", "x") else "0", -place, row))
    for size in (1, 5, 30):
        wanted = sorted(first.values(), key=lambda f: f[:2], reverse=True)[:size]
        assert cut(given, size, True) == sorted((row["url"], -place, row["published"]) for _, place, row in wanted)
