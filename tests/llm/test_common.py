from types import SimpleNamespace

import pytest

from plainfold.llm.common import one_per_id, work


def test_work_folders_are_shared_or_refused(spark):
    def session(root, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: root), sparkContext=SimpleNamespace(master=master), _jvm=spark._jvm, _jsc=spark._jsc)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            work(session(None, master))
    one, two = work(session(None, "local[2]")), work(session(None, "local[2]"))
    assert one != two and one.rpartition("/")[0] == two.rpartition("/")[0]
    assert work(session("file:///tmp/shared/", "yarn")).startswith("file:///tmp/shared/plainfold-")


def test_only_repeated_ids_are_compared(spark):
    rows = [(1, "a", None), (1, "b", 2), (1, "b", 1), (2, None, 5), (None, "z", 1), (3, "c", 1), (3, "c", 1)]
    df = spark.createDataFrame(rows, "id long, text string, `a.b` int")
    assert sorted((tuple(r) for r in one_per_id(df, "id", "text", "a.b").collect()), key=str) == [(1, "b", 2), (2, None, 5), (3, "c", 1)]
    assert sorted(r.id for r in one_per_id(df, "id").collect()) == [1, 2, 3]
    assert sorted(r.id for r in one_per_id(df.where("text is null"), "id", "text").collect()) == [2]
