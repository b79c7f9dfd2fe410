"""Large files that are read in blocks give the rows that whole ones give."""

import json
import random

import pytest

from palimpsest.sources import common, export_json, json_array, session_jsonl

LONG = "this is a message that is long enough to keep, number "
A = "7d3e2a1b-0000-4000-8000-00000000000a"


@pytest.fixture(params=[3000, 1 << 20])
def blocks(spark, request):
    """Blocks of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df):
    return sorted((json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect()))


def text(rng):
    return LONG + "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", "é", "日", "\n", "a", " ", '\\"', "}]", '","'], k=rng.randint(0, 60)))


def conversation(rng, i):
    message = lambda n: {"uuid": f"m{n}", "sender": rng.choice(["human", "assistant"]), "text": text(rng), "created_at": "2024-01-01T00:00:00Z", "x": {"y": [1, {"z": [text(rng)]}]}}
    return {"uuid": f"c{i}", "chat_messages": [message(n) for n in range(rng.randint(0, 5))]}


@pytest.mark.parametrize("indent, ascii_", [(None, True), (2, False)])
def test_exports(spark, tmp_path, blocks, indent, ascii_):
    rng = random.Random(blocks)
    for k in range(3):
        data = [conversation(rng, 100 * k + i) for i in range(12)] + ["odd", {"name": "no id"}, 5, None, {"uuid": "gamma"}, [], "}"]
        rng.shuffle(data)
        (tmp_path / f"e{k}").mkdir()
        (tmp_path / f"e{k}" / "conversations.json").write_text(("﻿" if k == 1 else " \n") + json.dumps(data, indent=indent, ensure_ascii=ascii_) + "\n" * k)
    whole, cut = export_json.extract(spark, str(tmp_path)), export_json.extract(spark, str(tmp_path), large=1)
    assert rows(cut.drawers) == rows(whole.drawers) and rows(cut.errors) == rows(whole.errors)
    assert whole.drawers.count() > 10


#: What follows the array here, Spark's parser of whole texts doesn't look at.
TRAILING = ("[1][2]", "[1] x", "[1]}", "[{}]}")


@pytest.mark.parametrize("content", ["[]", " [ ] \n", '[{"a": "}"}]', "{}", "[", "[1,]", "[1}", "[1] x", "[{}]}", "[{}", '[{"uuid": "a", "messages": []}}]'])
def test_arrays_that_are_none(spark, tmp_path, content):
    (tmp_path / "conversations.json").write_text(content)
    whole, cut = export_json.extract(spark, str(tmp_path)), export_json.extract(spark, str(tmp_path), large=1)
    got, want = rows(cut.errors), rows(whole.errors)
    if content[0] not in " [":  # what begins otherwise is not looked into any further
        assert len(got) == 1 and "expected top-level JSON array" in got[0] or "invalid JSON" in got[0]
    elif content in TRAILING:
        assert len(got) == 1 and "invalid JSON" in got[0]
    else:
        assert got == want
    assert rows(cut.drawers) == rows(whole.drawers)


def test_session_logs(spark, tmp_path, blocks):
    rng = random.Random(blocks)
    line = lambda **x: json.dumps(x, ensure_ascii=False)
    for name in (A, A.replace("7d", "8e"), "stray"):
        out = [line(role=rng.choice(["user", "assistant"]), content=text(rng), timestamp="2024-01-01T00:00:00Z", uuid=str(i)) for i in range(60)]
        out[7], out[20], out[41] = "{not json", "[1]", ""
        (tmp_path / f"{name} %+.jsonl" if name == "stray" else tmp_path / f"{name}.jsonl").write_bytes(("﻿" + ("\r\n" if name == A else "\n").join(out)).encode())
    whole, cut = session_jsonl.extract(spark, str(tmp_path)), session_jsonl.extract(spark, str(tmp_path), large=1)
    assert rows(cut.drawers) == rows(whole.drawers) and rows(cut.errors) == rows(whole.errors)
    assert whole.drawers.count() > 100 and whole.errors.count() == 5


def test_both_sizes_at_once(spark, tmp_path):
    for name, n in ((A, 3), (A.replace("7d", "8e"), 40)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"role": "user", "content": LONG + str(i)}) for i in range(n)))
    found = session_jsonl.extract(spark, str(tmp_path), large=1000)
    assert found.drawers.count() == 43 and common.large_files(spark, str(tmp_path), session_jsonl.handles(session_jsonl.F.col("path")), 1000) == [str(tmp_path / f"{A.replace('7d', '8e')}.jsonl")]


def test_cutter_against_the_parser():
    """Any way of feeding the bytes, one brace at a time as well, gives the array's elements."""
    rng = random.Random(3)
    for _ in range(60):
        data = [rng.choice([1, "a", [], {}, text(rng), conversation(rng, 1), [[text(rng)], {"k": text(rng)}]]) for _ in range(rng.randint(0, 6))]
        raw = json.dumps(data, indent=rng.choice([None, 1])).encode()
        cutter, found, at = json_array._Cutter(0, 0), [], 0
        while at < len(raw):
            ends = [i + 1 for i in range(at, len(raw)) if raw[i : i + 1] == b"}"]
            end = rng.choice(ends[:3]) if ends else len(raw)
            found += [t for _, t in cutter.feed(json_array.np.frombuffer(raw[at:end], json_array.np.uint8))]
            at = end
        assert found[0] == b"" and [json.loads(t) for t in found[1:] if t.strip()] == data and (cutter.opens, cutter.closes, cutter.depth, cutter.quotes % 2) == (1, 1, 0, 0)
