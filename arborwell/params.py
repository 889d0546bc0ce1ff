"""Training parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class GBDTParams:
    """All settings of a training run. reg_lambda below lambda_floor is raised to it; pass lambda_floor=0 to lift that."""

    loss: str = "binary:logistic"
    num_class: int = 2
    num_tree: int = 20
    max_depth: int = 6
    num_split: int = 100
    learning_rate: float = 1.0
    min_child_weight: float = 0.0
    min_node_instance: int = 1024
    min_split_gain: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    max_leaf_weight: float = 0.0
    feature_sample_ratio: float = 1.0
    enum_threshold: int = 32
    growth: str = "level"
    max_node_num: int = 0
    full_hessian: bool = False
    hist_subtraction: bool = True
    cuts: str = "exact"
    metrics: tuple[str, ...] = ()
    seed: int = 0
    lambda_floor: float = 1.0
    fast_math: bool = False  # the sigmoid of gradients by a table
    float32: bool = False  # feature values in single precision
    valid_ratio: float = 0.25
    num_feature: int = 0
    num_worker: int = 0
    lighter_child_first: bool = True
    model_path: str = ""
    train_path: str = ""
    valid_path: str = ""
    predict_path: str = ""

    def __post_init__(self) -> None:
        if self.num_class < 2 or self.num_tree < 0 or self.max_depth < 1 or self.num_split < 1:
            raise ValueError("num_class >= 2, num_tree >= 0, max_depth >= 1 and num_split >= 1 are required")
        if self.growth not in ("level", "leaf") or self.cuts not in ("exact", "kll"):
            raise ValueError("growth is level or leaf, cuts is exact or kll")
        if not 0 < self.feature_sample_ratio <= 1:
            raise ValueError("feature_sample_ratio lies in (0, 1]")

    @property
    def lam(self) -> float:
        return max(self.reg_lambda, self.lambda_floor)

    @property
    def outputs(self) -> int:
        """Margins per row."""
        return 1 if self.num_class == 2 else self.num_class

    #: Configuration keys and the fields they set.
    KEYS = {
        "spark.ml.loss.func": "loss", "spark.ml.class.num": "num_class", "spark.gbdt.tree.num": "num_tree", "spark.gbdt.max.depth": "max_depth",
        "spark.gbdt.split.num": "num_split", "spark.ml.learn.rate": "learning_rate", "spark.gbdt.min.child.weight": "min_child_weight",
        "spark.gbdt.min.node.instance": "min_node_instance", "spark.gbdt.min.split.gain": "min_split_gain", "spark.gbdt.reg.alpha": "reg_alpha",
        "spark.gbdt.reg.lambda": "reg_lambda", "spark.gbdt.max.leaf.weight": "max_leaf_weight", "spark.feature.sample.ratio": "feature_sample_ratio",
        "spark.ml.eval.metric": "metrics", "spark.gbdt.max.node.num": "max_node_num", "spark.gbdt.full.hessian": "full_hessian", "spark.gbdt.hist.subtraction": "hist_subtraction",
        "spark.ml.valid.ratio": "valid_ratio", "spark.ml.feature.num": "num_feature", "spark.ml.worker.num": "num_worker", "spark.gbdt.lighter.child.first": "lighter_child_first",
        "spark.ml.model.path": "model_path", "spark.ml.train.path": "train_path", "spark.ml.valid.path": "valid_path", "spark.ml.predict.path": "predict_path",
    }

    @classmethod
    def from_conf(cls, conf: dict[str, str]) -> GBDTParams:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        for key, name in cls.KEYS.items():
            if key in conf:
                v, kind = conf[key], kinds[name]
                found[name] = tuple(x.strip() for x in v.split(",") if x.strip()) if kind is tuple else v.lower() == "true" if kind is bool else kind(v)
        return cls(**found)
