"""What workers keep when a task is done: they live on, beside the stages that follow."""

import re
from pathlib import Path

import pyarrow as pa
from corpus_pipeline import STAGES

from bookflow.llm import common, line_dedup
from tests.llm.helpers import documents


def test_stages_tasks_give_memory_back(spark, sf, monkeypatch):
    docs = documents(spark, [(1, "a b c d e f"), (2, "g h i j k l")])
    frame, tasks = type(docs), []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *rest: tasks.append(run) or plain(self, run, *rest))
    for name, stage in STAGES:
        if name != "decontamination":  # no Python there
            seen = len(tasks)
            stage(spark, docs, sf)
            assert len(tasks) > seen, name
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    for k, run in enumerate(tasks, 1):
        assert list(run(iter([]))) == []
        assert len(given) == k


def test_freed_memory_goes_to_the_system():
    def own_mb():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def run(batches):
        for batch in batches:
            rows = [bytes(2000) for _ in range(100_000)]
            kept.append(bytes(2000))  # lies behind them, so that the heap does not shrink by itself
            yield batch.slice(0, len(rows))

    kept = []
    before = own_mb()
    list(run([pa.record_batch({"x": [1]})]))
    held = own_mb() - before
    list(common.tidy(run)([pa.record_batch({"x": [1]})]))
    assert own_mb() - before < max(60, held / 2)


def test_lines_are_taken_apart_by_portions():
    batch = pa.record_batch({"text": ["a\nb"] * 2500 + [None], "doc_id": list(range(2501))})
    done = list(line_dedup._remover({}, 0, 1)([batch]))
    assert max(map(len, done)) == line_dedup.PORTION < len(batch)
    assert pa.Table.from_batches(done).drop(["_lines", "_removed"]).to_pylist() == batch.to_pylist()
