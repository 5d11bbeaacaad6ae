"""Rules by name: registration, retired names, descriptors, evaluation modes and stored rules.

A stored rule is ``{"name": ..., "params": {...}}`` (also ``parameters``); it is evaluated at the
last bar of each symbol.  Live rules ask an injected provider on the driver, never in a task, and
are refused where only past readings are valid.
"""

from __future__ import annotations

import json
import logging
import re
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.signals import SIGNALS, resolve_params, signal_frame
from barloom.sources.bars import canonical_columns

log = logging.getLogger(__name__)

#: Retired names and what replaced them, and old parameter names.
RETIRED = {
    "apo_bullish": "macd_line_positive", "apo_bearish": "macd_line_negative", "apo_cross_up": "macd_line_cross_up", "apo_cross_down": "macd_line_cross_down",
    "chandelier_long_stop_hit": "cl_below_high_offset", "chandelier_short_stop_hit": "cl_above_low_offset", "volatility_stop_upper": "ve_above_upper", "volatility_stop_lower": "ve_below_lower",
}
OLD_PARAMETERS = {"short_period": ("window_fast",), "long_period": ("window_slow",), "lookback": ("window",), "period": ("window",)}


class LiveSignalNotAllowed(ValueError):
    """A live rule was asked for where only past readings are valid."""


class RuleRegistry:
    """All built-in signals and the rules a user adds."""

    def __init__(self):
        self.aliases = dict(RETIRED)
        self.custom: dict[str, tuple[Callable, str, str | None, bool, str]] = {}
        self.provider_factory: Callable | None = None

    def register(self, name: str, *, executable: bool = True, evaluation_mode: str = "frame", data_provider: str | None = None):
        """Decorator for ``f(bars, **params) -> DataFrame(symbol, ts, fired)``, or ``f(provider, **params) -> bool`` in live mode."""
        if evaluation_mode not in ("frame", "live"):
            raise ValueError(f"unknown evaluation mode {evaluation_mode!r}")
        if (evaluation_mode == "live") != bool(data_provider):
            raise ValueError("live rules need a data provider, frame rules have none")
        if data_provider is not None and not isinstance(data_provider, str):
            raise TypeError("a data provider is named by a string")
        if name in SIGNALS or name in self.custom and self.custom[name][1:3] != (evaluation_mode, data_provider):
            raise ValueError(f"{name!r} is registered already")

        def keep(f):
            self.custom[name] = (f, evaluation_mode, data_provider, executable, (f.__doc__ or "").strip())
            return f

        return keep

    def alias(self, old: str, new: str) -> None:
        self.aliases[old] = new

    def resolve(self, name: str) -> str:
        if name in self.aliases and name not in self.custom:
            warnings.warn(f"{name} is now {self.aliases[name]}", DeprecationWarning, stacklevel=2)
            return self.aliases[name]
        return name

    def names(self) -> frozenset[str]:
        return frozenset(SIGNALS) | frozenset(self.custom)

    def has(self, name: str) -> bool:
        return name in self.names() or name in self.aliases

    def describe(self, name: str) -> dict:
        name = self.aliases.get(name, name)
        if name in self.custom:
            _, mode, provider, executable, doc = self.custom[name]
            return {"name": name, "type": None, "requires": [], "params": {}, "mode": mode, "provider": provider, "category": "custom", "status": "active" if executable else "disabled", "composable": mode == "frame", "executable": executable, "legacy_compatible": False, "summary": doc}
        s = SIGNALS.get(name)
        if s is None:
            return {}
        kind = lambda v: "any" if v is None else type(v).__name__
        return {
            "name": name, "type": s.kind, "requires": list(s.requires), "params": {k: {"type": kind(v), "default": v, "optional": v is not None} for k, v in s.params.items()},
            "mode": "live" if s.live else "frame", "provider": s.live, "category": s.category, "status": "deprecated" if s.deprecated else "disabled" if s.disabled else "active",
            "composable": not s.live and not s.disabled, "executable": not s.disabled or s.deprecated, "legacy_compatible": s.deprecated, "summary": name.replace("_", " "),
        }

    def catalog(self, spark: SparkSession) -> DataFrame:
        """One row per rule; parameters as a map of their default, JSON-encoded."""
        rows = [(d["name"], d["type"], d["requires"], {k: json.dumps(v["default"]) for k, v in d["params"].items()}, d["mode"], d["provider"], d["category"], d["status"], d["composable"], d["executable"]) for d in map(self.describe, sorted(self.names()))]
        return spark.createDataFrame(rows, "name string, type string, requires array<string>, params map<string,string>, mode string, provider string, category string, status string, composable boolean, executable boolean")

    def validate_evaluation_mode(self, name: str, mode: str) -> None:
        if mode not in ("historical", "live"):
            raise ValueError(f"unknown evaluation mode {mode!r}")
        d = self.describe(name)
        if not d:
            raise ValueError(f"unknown rule {name!r}")
        if mode == "historical" and d["mode"] == "live":
            raise LiveSignalNotAllowed(f"{name} asks a live provider")

    def normalise(self, rule: dict) -> tuple[str, dict]:
        """Name and parameters of a stored rule, under their present names."""
        name = self.resolve(rule["name"])
        if not self.has(name):
            raise ValueError(f"unknown rule {name!r}")
        params = {**(rule.get("params") or {}), **(rule.get("parameters") or {})}
        known = SIGNALS[name].params if name in SIGNALS else None
        for old, (new,) in OLD_PARAMETERS.items():
            if known is not None and old in params and old not in known and new in known:
                params.setdefault(new, params.pop(old))
        return name, {k: tuple(v) if isinstance(v, list) else v for k, v in params.items()}

    def fired(self, bars: DataFrame, rules: list[dict]) -> DataFrame:
        """A boolean column per rule and bar, all frame rules in one plan."""
        bars = canonical_columns(bars)
        plain = [self.normalise(r) for r in rules]
        for n, _ in plain:
            self.validate_evaluation_mode(n, "historical")
            if not self.describe(n)["executable"]:
                raise ValueError(f"{n} is disabled")
        df = signal_frame(bars, [(n, p) for n, p in plain if n in SIGNALS])
        for n, p in plain:
            if n in self.custom:
                own = self.custom[n][0](bars, **p).select("symbol", "ts", F.coalesce("fired", F.lit(False)).alias(n))
                df = df.join(own, ["symbol", "ts"], "left")
        return df

    def evaluate(self, rule: dict, bars: DataFrame | None = None) -> DataFrame | bool:
        """``symbol, fired`` at the last bar of each symbol; of a live rule the provider's answer."""
        name, params = self.normalise(rule)
        if self.describe(name)["mode"] == "live":
            return self._live(name, params)
        df = self.fired(bars, [{"name": name, "params": params}])
        return df.groupBy("symbol").agg(F.max_by(name, "ts").alias("fired"))

    def configure_provider(self, factory: Callable | None) -> None:
        """The factory of the provider that live rules ask (on the driver)."""
        self.provider_factory = factory

    def _live(self, name: str, params: dict) -> bool:
        """No provider, or one that fails, gives False and a log entry."""
        if self.provider_factory is None:
            log.warning("%s: no provider is configured", name)
            return False
        try:
            x = self.provider_factory()
            if name in self.custom:
                return bool(self.custom[name][0](x, **params))
            p = resolve_params(SIGNALS[name], params)
            if name == "x_user_post_trigger":
                return bool(x.check_user_post_signal(username=p["username"], topic=p["topic"], max_posts_age_hours=p["max_age_hours"]))
            if name == "x_topic_mention_trigger":
                return bool(x.check_topic_mention_signal(topic=p["topic"], min_mentions=p["min_mentions"], min_followers=p["min_followers"], time_window_hours=p["time_window_hours"]))
            if name == "x_social_sentiment_trigger":
                return min(_volume(x.detect_social_sentiment(symbol=p["symbol"], time_window_hours=p["time_window_hours"])) * 10, 100) >= p["threshold"]
            if name == "x_user_influence_filter":
                return float(x.get_user_influence_score(username=p["username"])) >= p["min_influence_score"]
            return min(_volume(x.detect_social_sentiment(symbol=p["topic"], time_window_hours=24)) * 10, 100) >= p["min_sentiment"]
        except Exception:
            log.exception("%s: the provider failed", name)
            return False


def _volume(answer) -> float:
    return float(answer.get("mention_volume", 0)) if isinstance(answer, dict) else float(answer)


def parse_rules(text: str) -> list[dict]:
    """Stored rules from JSON: one object or a list of them."""
    got = json.loads(text)
    return got if isinstance(got, list) else [got]


#: Section names of an authored description.
_SECTIONS = ("Formula", "Inputs", "Params", "Outputs", "Warmup", "Reference", "Type", "Requires", "Args", "Returns", "Disabled", "Disabled-Reason", "Friendly-Name", "Display-Name", "Short-Description")
_SECTION = re.compile(r"^[ \t]*(" + "|".join(_SECTIONS) + r"):[ \t]*(.*)$")
_PARAM = re.compile(r"^[ \t]*(\w+)[ \t]*(?:\[([^\]]*)\]|\(([^)]*)\))[ \t]*:[ \t]*(.*)$")


def parse_signal_docstring(doc: str) -> dict:
    """Name, type, requires, policy and parameters (type, range, options, default) authored in a rule's docstring.

    A missing docstring gives empty fields.  Unknown lines belong to the section above them.
    """
    out: dict = {"name": None, "type": None, "requires": [], "params": {}, "disabled": False, "reason": None, "sections": {}}
    section = None
    for line in (doc or "").splitlines():
        if m := re.match(r"^[ \t]*Signal:[ \t]*(\w+)", line):
            out["name"] = m[1]
            continue
        if m := _SECTION.match(line):
            section = m[1]
            out["sections"].setdefault(section, []).append(m[2].strip())
            continue
        if section and line.strip():
            out["sections"][section].append(line.strip())
        if section in ("Args", "Params") and (m := _PARAM.match(line)):
            text = m[4]
            p = out["params"].setdefault(m[1], {"type": None, "min": None, "max": None, "default": None, "options": None})
            if m[3]:
                p["type"] = m[3]
            for k, v in (x.split("=", 1) for x in (m[2] or "").split(",") if "=" in x):
                p[k.strip()] = v.strip()
            if r := re.search(r"Range:\s*(-?[\d.]+)\s*-\s*(-?[\d.]*\d)", text):
                p["min"], p["max"] = r[1], r[2]
            if r := re.search(r"Default:\s*([^\s.]+(?:\.\d+)?)", text):
                p["default"] = r[1]
            if r := re.search(r"Options:\s*([^.]+)", text):
                p["options"] = [o.strip() for o in r[1].split(",")]
    first = lambda k: next((x for x in out["sections"].get(k, []) if x), None)
    out["type"] = first("Type")
    out["requires"] = [c.strip() for c in (first("Requires") or "").split(",") if c.strip() and c.strip() != "None"]
    out["disabled"] = (first("Disabled") or "").lower() == "true"
    out["reason"] = first("Disabled-Reason")
    out["params"].pop("df", None)
    return out
