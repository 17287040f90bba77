"""Wrong input is refused."""

from __future__ import annotations

from dataclasses import replace
from types import SimpleNamespace

import pytest

from stratavec import defaults as D
from stratavec.functions import buckets
from stratavec.operators import heads, sampling
from stratavec.plans.capture import captured_layers
from stratavec.session import scratch_path


def test_strategies():
    with pytest.raises(ValueError, match="unsupported sampler"):
        sampling.sampler_by_name("weekly")
    for bad in (0, -3):
        with pytest.raises(ValueError, match="at least 1"):
            sampling.sampler_by_name("uniform", 1.0, bad)
        with pytest.raises(ValueError, match="at least 1"):
            buckets.floor_power(bad)
    assert sampling.sampler_by_name("ALL").name == "all"


def test_layers_and_heads():
    with pytest.raises(ValueError, match="no layers"):
        captured_layers(replace(D.SETTINGS, layers=(0, 4)))
    assert captured_layers(replace(D.SETTINGS, full_attention_only=True)) == [0, 2]
    with pytest.raises(ValueError, match="multiple"):
        D.Layout(q_heads=3, k_heads=2)


def test_missing_heads(spark):
    rows = spark.createDataFrame([(0, 0, "q")], "layer int, head int, kind string")
    with pytest.raises(ValueError, match="k has no heads"):
        heads.filter_layers_heads(rows, D.LAYOUT, None, {3})
    # only the captured kinds are checked
    heads.filter_layers_heads(rows, D.LAYOUT, None, {3}, ("q",))
    with pytest.raises(ValueError, match="at least 1"):
        heads.with_sampled_heads(rows, 0)


MODEL = "model string, num_layers int, q_heads int, k_heads int, layer_types array<string>"


@pytest.mark.parametrize(
    "kwargs, message",
    [
        ({"layers": [5]}, "not all in the model"),
        ({"heads": [-1]}, "not all in the model"),
        ({"full_attention_only": True}, "no query head is left"),
    ],
)
def test_candidates(spark, kwargs, message):
    models = spark.createDataFrame([("m", 2, 4, 2, [D.SLIDING] * 2)], MODEL)
    with pytest.raises(Exception, match=message):
        heads.explode_heads(heads.with_candidates(models, **kwargs), "candidates").collect()


@pytest.mark.parametrize(
    "config, message",
    [
        ("{}", "no attention head layout"),
        ("not json", "no attention head layout"),
        ('{"num_hidden_layers": 1, "num_attention_heads": 0}', "no attention head layout"),
        (
            '{"num_hidden_layers": 1, "num_attention_heads": 3, "num_key_value_heads": 2}',
            "not a multiple",
        ),
    ],
)
def test_configs(spark, config, message):
    frame = spark.createDataFrame([(1, config)], "model int, config string")
    with pytest.raises(Exception, match=message):
        heads.head_layout(frame).collect()


class Session:
    """The two settings ``scratch_path`` looks at."""

    def __init__(self, master, folder=None):
        self.sparkContext = SimpleNamespace(master=master)
        self.conf = SimpleNamespace(get=lambda key, default: folder or default)


def test_scratch_folder(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    shared = Session("yarn", "hdfs:///shared/folder/")
    assert scratch_path(shared, "a").startswith("hdfs:///shared/folder/stratavec-a-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(Session("yarn"), "a")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(Session("local-cluster[3,2,1024]"), "a")
    for master in ("local", "local[*]", "local[8,2]"):
        assert "stratavec-a-" in scratch_path(Session(master), "a")
