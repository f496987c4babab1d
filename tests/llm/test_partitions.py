"""The ten queries give the same rows whatever the number of partitions."""

from __future__ import annotations

import pytest

from corpusmill.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_partitions_do_not_matter(spark, name):
    seen = []
    for n in ("2", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(repr, QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and len(seen[0]) > 0
