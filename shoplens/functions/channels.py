"""Traffic classifiers over session columns.

CASE order matters and a classifier without a fallback label leaves
unmatched sessions in a NULL group, as the analyses expect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Referer URLs of the two search engines and channel labels.
GSEARCH_REFERER = "https://www.gsearch.com"
BSEARCH_REFERER = "https://www.bsearch.com"
SEARCH_REFERERS = [GSEARCH_REFERER, BSEARCH_REFERER]


def traffic_type() -> Column:
    """direct_type_in / gsearch_organic / bsearch_organic / others."""
    src, ref = F.col("utm_source"), F.col("http_referer")
    return (F.when(ref.isNull(), "direct_type_in")
            .when((ref == GSEARCH_REFERER) & src.isNull(), "gsearch_organic")
            .when((ref == BSEARCH_REFERER) & src.isNull(), "bsearch_organic")
            .otherwise("others"))


def channel_group(with_social: bool = False) -> Column:
    """organic_search / paid_nonbrand / paid_brand / direct_type_in
    (/ paid_social); NULL when nothing matches."""
    src, camp, ref = F.col("utm_source"), F.col("utm_campaign"), F.col("http_referer")
    c = (F.when(src.isNull() & ref.isin(*SEARCH_REFERERS), "organic_search")
         .when(camp == "nonbrand", "paid_nonbrand")
         .when(camp == "brand", "paid_brand")
         .when(src.isNull() & ref.isNull(), "direct_type_in"))
    if with_social:
        c = c.when(src == "socialbook", "paid_social")
    return c
