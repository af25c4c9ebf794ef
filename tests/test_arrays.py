"""Long JSON documents cut by many tasks, with ranges of a few bytes."""

import json
import random

import pytest

from millrace.sources import arrays
from millrace.sources import catalog as store


@pytest.fixture
def small(spark, monkeypatch):
    """Every document is cut, in ranges of some bytes."""
    monkeypatch.setattr(store, "SPLIT_BYTES", 0)
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield monkeypatch
    for k, v in before.items():
        spark.conf.set(k, v)


def values(spark, path):
    rows = sorted((r.pos, json.loads(r.value)) for r in store.read_raw(spark, str(path), "items").collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    return [r[1] for r in rows]


HARD = ['"', '\\"', "\\\\", "]", "[", "}", "{", "},{", '"},{"', "\\", "é", "日本", "😀", ",", ":", " ", "\n", '\\u005d', '{"items": [']


def made_up(r, depth=0):
    kind = r.random()
    if depth > 2 or kind < 0.4:
        return r.choice([None, True, 7, -1.5, "".join(r.choices(HARD, k=r.randint(0, 6)))])
    if kind < 0.6:
        return [made_up(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {"".join(r.choices(HARD, k=2)) + str(i): made_up(r, depth + 1) for i in range(r.randint(0, 4))}


@pytest.mark.parametrize("seed", range(2))
def test_lists_of_anything(spark, small, tmp_path, seed):
    r = random.Random(seed)
    records = [made_up(r) for _ in range(60)]
    path, wrapped = tmp_path / "list.json", tmp_path / "wrapped.json"
    path.write_text(json.dumps(records, indent=seed or None, ensure_ascii=bool(seed)) + "\n" * seed, encoding="utf-8-sig" if seed else "utf-8")
    wrapped.write_text(json.dumps({"a": [1, {"items": [2]}], "b": '{"items": [', "items": records, "c": [[3], {"d": "]}"}]}, indent=2 - 2 * seed or None))
    assert values(spark, path) == records and store.is_list(spark, str(path))
    assert values(spark, wrapped) == records and not store.is_list(spark, str(wrapped))


def test_lines_and_list_are_alike(spark, small, tmp_path):
    rows = [{"id": f"a-{i}", "title": "T" * (i % 90), "topics": ["x}", "y]"][: i % 3]} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    # it is read in many ranges, and small buffers change nothing
    assert len(arrays._blocks(arrays._pieces(spark, str(tmp_path / "a.json")))) > 10
    small.setattr(arrays, "BUFFER", 7)
    a, b = (store.read_json(spark, str(tmp_path / n)).orderBy("pos").drop("pos").collect() for n in ("a.json", "a.jsonl"))
    assert a == b and len(a) == 60


def read(spark, tmp_path, texts):
    """The records of each text, or why it is an error."""
    out = []
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
        try:
            out.append(values(spark, tmp_path / f"{i}.json"))
        except Exception as error:  # noqa: BLE001
            out.append("no JSON" if "no JSON" in str(error) else str(error))
    return out


def test_documents_without_records(spark, small, tmp_path):
    texts = [" [ ] ", "", " \n", '{"items": []}', '{"items": {"a": [1]}}', '{"other": [1, 2]}', '{"items": null, "b": [1]}']
    assert read(spark, tmp_path, texts) == [[]] * len(texts)


def test_what_is_no_json_is_an_error(spark, small, tmp_path):
    texts = ["[1, 2", '["a', "[1,]", "[1,,2]", "[1] x", "[1],[2]", "[1] [2]", '[1] {"a": 2}', "[{]}", "7", '[{"a": 1} {"b": 2}]', '{"items": [1, nope]}', "[1]]"]
    assert read(spark, tmp_path, texts) == ["no JSON"] * len(texts)
