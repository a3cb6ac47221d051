from vitrina.operators.vocabulary import item_terms, large_vocabulary, vocabulary
from vitrina.sources.taxonomy import category_tree, enrich_by_ancestors


def test_tree_of_any_depth(spark):
    deep = '{"id":"d9","name":"end"}'
    for i in range(8, -1, -1):
        deep = f'{{"id":"d{i}","name":"n{i}","children_categories":[{deep}]}}'
    texts = [
        deep,
        '[{"id":"a","name":"Música","children_categories":[{"id":"b","name":"Discos"},{"name":"no id","children_categories":[{"id":"lost","name":"x"}]}]}, {"id":"c"}]',
        '{"id":"b","name":"root b","children_categories":[]}', '{"id":"d0","name":"n0"}', "not json", "", None,
    ]
    found = {r["id"]: r for r in category_tree(spark.createDataFrame([(t,) for t in texts], "value string")).collect()}
    assert set(found) == {f"d{i}" for i in range(10)} | {"a", "b", "c"}
    assert found["d9"].depth == 9 and found["d9"].path == [f"d{i}" for i in range(10)] and found["d9"].parent == "d8"
    assert found["d9"].names[-1] == "end" and found["d0"].parent is None
    assert (found["b"].depth, found["b"].name, found["b"].parent) == (0, "root b", None)
    assert found["c"].name is None and found["c"].names == [""]
    assert not category_tree(spark.createDataFrame([], "value string")).take(1)


def test_enrich_by_ancestors(spark):
    tree = category_tree(spark.createDataFrame([('{"id":"a","name":"A","children_categories":[{"id":"b","name":"B"}]}',)], "value string"))
    items = spark.createDataFrame([(1, "cd", "b"), (2, "dvd", "?"), (None, "x", None), (1, "cd", "a")], "item_id int, title string, cat_0 string")
    assert sorted(r.title for r in enrich_by_ancestors(items, tree, "cat_0").collect()) == ["cd A", "cd A B", "dvd", "x"]


def test_large_vocabulary_equals_the_ranked_one(spark):
    rows = [(i, [f"w{k:03d}" for k in range(0, 200, 1 + i % 7)] + ["hot"] * 3) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id long, terms array<string>")
    for size in (1, 7, 50, 1000):
        large, ranked = large_vocabulary(df, "terms", size, 3), vocabulary(df, "terms", size, 3)
        assert sorted(map(tuple, large.collect())) == sorted(map(tuple, ranked.collect()))
    vocab = large_vocabulary(df, "terms", 50)
    joined, sent = (
        sorted((r.item_id, sorted(tuple(t) for t in r.terms)) for r in item_terms(df, "terms", vocab, [], max_terms=m).collect()) for m in (0, 1000)
    )
    assert joined == sent
    assert not large_vocabulary(df.limit(0), "terms", 5).take(1)
