from pyspark.ml.feature import SQLTransformer

from vitrina.session import new_path
from vitrina.sources.models_io import load_model, save_model


def test_names_that_differ_have_models_of_their_own(spark):
    root = new_path(spark, "named")
    names = ["a/b", "a_b", "a%2Fb", "a*b", "niño-cat_1"]
    for i, name in enumerate(names):
        save_model(root, name, SQLTransformer(statement=f"SELECT {i} AS n FROM __THIS__"))
    one = spark.range(1)
    assert [load_model(root, name).transform(one).first().n for name in names] == [0, 1, 2, 3, 4]
