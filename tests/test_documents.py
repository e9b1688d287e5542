"""Documents of a table and its queries: each semantic choice that a wrong engine would fail."""

import json

import pytest

from columnade.operators import Engine
from columnade.sources import json_document

#: name: (columns, rows, {predicate: ids})
DOCUMENTS = {
    "ranges_of_text": (
        {"id": "STRING", "word": "STRING"},
        [("1", "Bear"), ("2", "cat"), ("3", "DOG"), ("4", "apple"), ("5", "Zebra"), ("6", "BEETLE"), ("7", None)],
        {"word BETWEEN 'Bear' AND 'Dog'": "1 2 3 6", "word NOT BETWEEN 'bear' AND 'dog'": "4 5", "word < 'BEE'": "1 4", "word >= 'CAT'": "2 3 5", "word = 'dog'": "3", "word != 'dog'": "1 2 4 5 6"},
    ),
    "missing_groups": (
        {"id": "STRING", "team": "STRING", "size": "INT"},
        [("1", "red", 4), ("2", "blue", 9), ("3", "RED", None), ("4", None, 7), ("5", "", 0)],
        {
            "team NOT IN ('RED')": "2 4 5", "team IN ('red')": "1 3", "NOT team = 'red'": "2", "team IS NULL": "4 5", "team = ''": "", "team IS NOT NULL AND size > 3": "1 2",
            "team = 'red' OR size > 5": "1 2", "size IS NULL": "3", "size NOT IN (4, 9)": "3 4 5", "NOT (team = 'red' AND size = 4)": "2",
        },
    ),
    "numbers": (
        {"id": "INT", "n": "INT", "d": "DOUBLE"},
        [(1, 10, 2.5), (2, 20, 19.0), (3, 30, 60.5), (4, None, None)],
        {
            "n BETWEEN 10 AND d": "3", "n + 5 = 15": "1", "n * 2 >= d": "1 2", "n / 4 = 2.5": "1", "n - d < 0": "3", "d IN (19, 60.5)": "2 3", "n > 10 AND NOT d < 20.0": "3",
            "-n < -15": "2 3", "n = 10.0": "1", "n < 20.5": "1 2", "n <> 20": "1 3",
        },
    ),
    "times": (
        {"id": "INT", "at": "DATETIME", "span": "STRING"},
        [(1, "2024-05-06T07:08:09Z", "3 days"), (2, 1700000000, "INTERVAL"), (3, "2023", None), (4, 0, "x"), (5, None, None)],
        {
            "at + 1 = 1700086400": "2", "at - at = 0": "1 2 3", "YEAR(at) = 2023": "2 3", "EXTRACT(MONTH FROM at) = 5": "1", "at BETWEEN '2023-01-01' AND '2023-12-31T23:59:59'": "2 3",
            "at > 1700000000": "1", "at IS NULL": "4 5", "span = INTERVAL '3 DAYS'": "1", "at + INTERVAL '1 month' > '2024-06-01'": "1", "DATEPART(DAY, at) IN (1, 6)": "1 3", "at = TIMESTAMP '2024-05-06 07:08:09'": "1",
        },
    ),
    "patterns": (
        {"id": "STRING", "name": "STRING"},
        [("a", "Old Mill"), ("b", "oldmill"), ("c", "Mill 100%"), ("d", None)],
        {"name LIKE 'old%'": "a b", "name LIKE '%mill'": "a b", "name LIKE 'OLD_MILL'": "a", "name LIKE 'o l l'": "a b", "name NOT LIKE 'old%'": "c", "LENGTH(name) = 7": "b", "name LIKE '%'": "a b c", "id = 'A'": "a"},
    ),
    "places": (
        {"id": "INT", "lat": "DOUBLE", "lon": "DOUBLE"},
        [(1, 52.52, 13.405), (2, 48.8566, 2.3522), (3, None, 2.0), (4, 52.52, 13.405)],
        {"GEO_DISTANCE(lat, lon, 52.52, 13.405) < 1": "1 4", "GEO_DISTANCE(lat, lon, 52.52, 13.405) BETWEEN 540 AND 550": "2", "GEO_DISTANCE(lat, lon, 0.0, 0.0) IS NULL": "3", "ROUND(lat) = 53": "1 4"},
    ),
}


@pytest.mark.parametrize("name", list(DOCUMENTS))
def test_documents_and_their_queries(spark, tmp_path, name):
    columns, rows, asked = DOCUMENTS[name]
    told = {"table": {"name": name, "columns": [{"name": n, "type": k} for n, k in columns.items()], "rows": [dict(zip(columns, r, strict=True)) for r in rows]}}
    told["queries"] = [{"sql": sql, "expected": ids.split()} for sql, ids in asked.items()]
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    df, queries = json_document(spark, path)
    assert [(q["sql"], sorted(str(r.id) for r in Engine(spark).filter(df, q["sql"]).collect())) for q in queries] == [(q["sql"], sorted(q["expected"])) for q in queries]
