"""What operators write goes with the workspace they wrote it in."""

import os
import threading

import pytest

from corpusloom import storage
from corpusloom.operators import dedup
from corpusloom.plans import catalogue


def held(path):
    return os.listdir(path) if os.path.isdir(path) else []


def test_a_workspace_goes_with_all_it_holds(spark):
    docs = spark.createDataFrame([(k, f"one text of some words {k // 2}") for k in range(20)], "doc_id long, text string")
    shared = storage.shared_dir(spark)
    before = set(os.listdir(shared))
    with storage.workspace(spark) as path:
        classes = dedup.near_duplicate_classes(docs, "doc_id", "text", 0.8)
        rows = classes.collect()
        assert len(rows) == 20 and held(path)
    assert not os.path.exists(path) and set(os.listdir(shared)) == before


def test_workspaces_nest_and_end_after_errors(spark):
    with storage.workspace(spark) as outer:
        with pytest.raises(ZeroDivisionError), storage.workspace(spark) as inner:
            storage.written(spark.range(3), "numbers")
            assert inner.startswith(outer) and held(inner)
            1 / 0  # noqa: B018
        assert not os.path.exists(inner)
        kept = storage.written(spark.range(3), "numbers")
        assert kept.count() == 3 and len(held(outer)) == 1
        storage.forget(kept)
        assert not held(outer)
    assert not os.path.exists(outer)
    with storage.workspace(spark):
        pass  # nothing was written


def test_another_thread_has_its_own(spark):
    found = []
    with storage.workspace(spark) as path:
        other = threading.Thread(target=lambda: found.append(storage.new_path(spark, "x")))
        other.start()
        other.join()
        assert storage.new_path(spark, "x").startswith(path)
    assert not found[0].startswith(path)


@pytest.mark.parametrize("name", ["tar_samples", "write_tars", "zip_manifest", "write_dataset", "upsert_batches", "near_dedup_bands"])
def test_queries_leave_nothing(name, spark, sf_dir):
    """The sinks, sources and streams of registered queries write inside the workspace as well."""
    shared = storage.shared_dir(spark)
    before = set(os.listdir(shared))
    with storage.workspace(spark):
        n = len(catalogue.QUERIES[name](spark, sf_dir).collect())
    assert n and set(os.listdir(shared)) == before
