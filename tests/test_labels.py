"""Labels by a map of the page equal labels by a join."""

from pagetext.operators import graph


def test_labels_by_map_and_by_join(spark, monkeypatch):
    nodes = spark.createDataFrame([(p, i, f"{i}") for p in range(20) for i in range(12)] + [(None, 1, "x"), (90, 5, None)], "page int, block_id int, t string")
    edges = spark.createDataFrame([(p, i, i + 1 + p % 3) for p in range(20) for i in range(0, 9, 2 + p % 2)], "page int, block_id int, r_block_id int")
    made = {}
    for most in (64, 7, 0):
        monkeypatch.setattr(graph, "FEW_NODES", most, raising=False)
        d = graph.label_components(nodes, edges, ["page"], "block_id")
        made[most] = (d.schema.simpleString(), sorted(map(tuple, d.collect()), key=str))
    assert made[64] == made[7] == made[0] and len(made[0][1]) == nodes.count()
    joins = graph.label_components(nodes, edges, ["page"], "block_id")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "FEW_NODES", 64)
    mapped = graph.label_components(nodes, edges, ["page"], "block_id")._jdf.queryExecution().executedPlan().toString()
    assert "block_id" in joins and all("block_id" not in row for row in mapped.splitlines() if "Join" in row)  # nodes are not dealt by id
