"""The inventory of many files, folder by folder."""

import hashlib

from pyspark.sql import functions as F


def test_many_pages_are_listed_folder_by_folder(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries
    from panelcheck.plans.catalog import flows
    from panelcheck.sources import files as FI

    rows = [(k, f"u{k}", None if k == 3 else f"<p>{k}</p>\né") for k in range(40)]
    spark.createDataFrame([*rows, (7, "again", "more")], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    asked, whole = [], FI.image_inventory
    monkeypatch.setattr(flows, "FILES", 8, raising=False)
    monkeypatch.setattr(FI, "image_inventory", lambda s, *folders: asked.extend(folders) or whole(s, *folders))
    got = {r.page_id: (r.length, r.sha256) for r in queries()["s5_image_inventory"](spark, str(tmp_path)).collect()}
    of = lambda text: (len(text), hashlib.sha256(text).hexdigest())
    want = {k: of(((html or "") + "\n").encode()) for k, _, html in rows if k != 7}
    assert {k: v for k, v in got.items() if k != 7} == want and got[7][0] == len("<p>7</p>\né\nmore\n".encode())
    assert len(asked) == 6
    most = max(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(x).select(F.count("path")).first()[0] for x in asked)
    assert most < 40
