"""P16 reads the whole of each page."""

import re

from conftest import SF_SMALL

from newslens.functions import exprs as X
from newslens.plans.queries import p16_urls_in_text


def test_urls_behind_the_beginning_of_a_page_are_found(spark, scratch):
    url = "http://far.example/behind"
    pages = [(r.page_id, r.url, f"{r.html} {url}{r.page_id} ") for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").limit(20).collect()]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{scratch}/pages.parquet")
    got = {(x.page_id, x.url) for x in p16_urls_in_text(spark, scratch).collect()}
    assert {(k, f"{url}{k}") for k, _, _ in pages} <= got
    assert {(k, u) for k, _, h in pages for u in re.findall(X.URL_IN_TEXT_PATTERN, h)} <= got
