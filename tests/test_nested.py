import datetime as dt
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators.nested import TENDER_LINKS, distinct_links, extract, latest_links


def brute(text):
    """The same links by a plain JSON parser."""
    try:
        doc = json.loads(text) if text is not None else None
        for _ in range(6):
            if isinstance(doc, str):
                doc = json.loads(doc)
            elif isinstance(doc, dict) and "id" not in doc:
                for name in ("response", "data"):
                    doc = doc[name] if isinstance(doc, dict) and name in doc else doc
    except ValueError:
        return None
    if not isinstance(doc, dict):
        return None
    def text_of(value):
        if isinstance(value, str):
            return value if value.strip() else None
        if value is None or isinstance(value, (dict, list)):
            return None
        return json.dumps(value)
    def children(owner, name, key):
        held = owner.get(name)
        if isinstance(held, list):
            found = held
        elif isinstance(held, dict):
            leaf = key is not None and (key in held or any(not isinstance(v, (dict, list)) for v in held.values()))
            found = [held] if leaf else list(held.values())
        elif isinstance(held, str) and key is None:
            found = [held]
        else:
            found = []
        return found if key is None else [x for x in found if isinstance(x, dict)]
    out = set()
    for link in TENDER_LINKS:
        owners = [doc]
        for name in link.parents:
            owners = [c for o in owners for c in children(o, name, "id")]
        for o in owners:
            parent = text_of(o.get("id"))
            for c in children(o, link.child, link.child_id):
                child = text_of(c) if link.child_id is None else text_of(c.get(link.child_id))
                child = child.strip() if child and link.child_id is None else child
                if parent and child:
                    out.add((link.table, parent, child))
    return out


def got(text):
    found = extract([text], TENDER_LINKS, False)[0]
    return None if found is None else {r[:3] for r in found[1]}


def test_shapes():
    change = {"id": "c1", "rationaleTypes": [" a ", "b", None, ""]}
    docs = [
        {"id": "t", "awards": [{"id": "a1"}, {"x": 1}, {"id": " "}, {"id": 7}, "a9"]},
        {"id": "t", "awards": {"id": "a1", "value": {"amount": 1}}},
        {"id": "t", "awards": {"k1": {"id": "a1"}, "k2": {"id": "a2"}}},
        {"response": {"data": {"id": "t", "changes": {"0": change, "1": {"rationaleTypes": ["z"]}}}}},
        {"data": {"id": "t", "changes": [{"id": "c2", "rationaleTypes": "plain"}]}},
        {"id": "t", "bids": [{"id": "b", "lotValues": [{"relatedLot": "l1"}, {"relatedLot": None}]}, {"lotValues": [{"relatedLot": "l"}]}]},
        {"id": "t", "bids": [{"id": "b\\\"q", "lotValues": {"relatedLot": "lé", "value": {}}}], "awards": None, "x": "{[,:"},
    ]
    for doc in docs:
        for text in (json.dumps(doc), json.dumps(doc, indent=2), json.dumps(doc, ensure_ascii=False), json.dumps(json.dumps(doc))):
            assert got(text) == brute(text), text


def test_unreadable():
    whole = json.dumps({"id": "t", "awards": [{"id": "a1", "n": -1.5e3, "b": True, "z": None}]})
    for cut in range(len(whole)):
        assert got(whole[:cut]) is None, whole[:cut]
    for text in (None, "", "   ", "null", "12", "[1]", "<html>", "{} {}", '{"a" 1}', '{"a":1,}', '{"a":tru}', '[1,,2]', '{"a":1]', '{1:2}', '"x"', '{"a":"b\nc"}', "{,}", '{"a"}', '{"a":}'):
        assert got(text) is None, text
    assert got("{}") == set() and got(" [] ") is None


def test_many_texts_in_one_chunk_do_not_disturb_each_other():
    texts = ['{"id":"t1","awards":[{"id":"a"}]}', '{"id":"t2","awards":[{"id":"', None, "", '{"id":"t3","awards":[{"id":"b"}]}', "}", '"', '{"id":"t4","awards":[{"id":"c"}]}']
    found = extract(texts, TENDER_LINKS, True)
    assert [None if f is None else (f[0], [r[2] for r in f[1]]) for f in found] == [("t1", ["a"]), None, None, None, ("t3", ["b"]), None, None, ("t4", ["c"])]
    assert found[0][1][0][4] == '{"id":"a"}'


values = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text(alphabet='ab"\\{[,:é', max_size=4),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["id", "awards", "changes", "bids", "lotValues", "relatedLot", "rationaleTypes", "x"]), x, max_size=4),
    max_leaves=25,
)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(["id", "awards", "changes", "bids"]), values, max_size=4), st.integers(0, 3))
def test_any_document_like_the_plain_parser(doc, indent):
    doc["id"] = "root"
    text = json.dumps(doc, indent=indent or None)
    assert got(text) == brute(text)


def test_latest_readable_version(spark):
    at = dt.datetime(2020, 1, 1)
    body = lambda *ids: json.dumps({"id": "t", "awards": [{"id": i} for i in ids]})
    rows = [
        (1, "t", "2020-01-01T10:00:00+02:00", at, body("old")),
        (2, "t", "2020-01-01T09:00:00Z", at, body("new", "new")),
        (3, "t", "2020-02-01T00:00:00Z", at, body("cut")[:-3]),
        (4, "t", None, at, body("undated")),
        (5, "u", "no date", at, body("u")),
        (6, "w", "2020-01-01T09:00:00Z", at, None),
        (7, None, None, None, body("v").replace('"t"', '"v"')),
    ]
    df = spark.createDataFrame(rows, "record_id long, object_id string, date_modified string, fetched_at timestamp_ntz, body string")
    assert {tuple(r) for r in distinct_links(latest_links(df)).collect()} == {("awards", "t", "new"), ("awards", "t", "u"), ("awards", "v", "v")}
    assert latest_links(df.limit(0)).count() == 0


def test_long_text():
    rng = random.Random(1)
    doc = {"id": "t", "awards": [{"id": f"a{i}", "t": "x" * rng.randrange(500)} for i in range(20_000)]}
    assert len(got(json.dumps(doc))) == 20_000
