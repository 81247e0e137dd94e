"""Settings from a YAML file: what a ranking takes, each with a default."""

from __future__ import annotations

from tamarack.operators import ranking, rules

_WORDS = {"true": True, "false": False, "null": None, "none": None, "~": None, "": None}


def scalar(text: str):
    """A plain YAML scalar: a word, a number, or else the text without its quotes."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse(text: str) -> dict:
    """The part of YAML that settings need: nested maps by indentation, lists of scalars, comments. For where PyYAML isn't there."""
    lines = [(len(raw) - len(raw.lstrip()), raw.split(" #")[0].strip()) for raw in text.splitlines() if raw.strip() and not raw.strip().startswith("#")]

    def block(at: int, indent: int):
        held: dict | list | None = None
        while at < len(lines) and lines[at][0] >= indent:
            depth, line = lines[at]
            if line.startswith("- "):
                held = [] if held is None else held
                held.append(scalar(line[2:]))
                at += 1
                continue
            held = {} if held is None else held
            key, _, rest = line.partition(":")
            at += 1
            if rest.strip():
                held[key.strip()] = scalar(rest)
            else:
                deeper = at < len(lines) and (lines[at][0] > depth or lines[at][1].startswith("- ") and lines[at][0] >= depth)
                held[key.strip()], at = block(at, lines[at][0]) if deeper else (None, at)
        return held, at

    found, _ = block(0, 0)
    return found if isinstance(found, dict) else {}


def load(path: str | None) -> dict:
    """The settings of a file, an empty map without one; PyYAML reads it if it is installed."""
    if not path:
        return {}
    with open(path, encoding="utf-8-sig") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return parse(text)
    found = yaml.safe_load(text)
    return found if isinstance(found, dict) else {}


def firewall(config: dict) -> rules.Firewall:
    own = config.get("honeypot_firewall") or {}
    base = rules.Firewall()
    levels = own.get("risk_thresholds") or {}
    return rules.Firewall(
        disqualify_severe=bool(own.get("disqualify_severe", base.disqualify_severe)),
        max_penalty=float(own.get("max_risk_penalty", base.max_penalty)),
        thresholds=tuple(float(levels.get(k, v)) for k, v in zip(("low", "medium", "high"), base.thresholds, strict=True)),
        penalties=base.penalties | (own.get("penalties") or {}),
        year=int((config.get("reproducibility") or {}).get("reference_year", base.year)),
    )


def settings(
    config: dict, *, top_k: int | None = None, risk: bool | None = None, calibrate: bool | None = None,
    strict_pool: int | None = None, strict_top_n: int | None = None, risk_pool: int | None = None, calibration_pool: int | None = None,
) -> ranking.Settings:
    """The settings of a ranking; arguments that aren't None overrule the file."""
    own, wall, tune = (config.get(k) or {} for k in ("ranking", "honeypot_firewall", "evidence_calibration"))
    base = ranking.Settings()
    risk = bool(wall.get("enabled", False)) if risk is None else risk
    calibrate = bool(tune.get("enabled", False)) if calibrate is None else calibrate
    year = (config.get("reproducibility") or {}).get("reference_year")
    return ranking.Settings(
        top_k=int(top_k or own.get("top_k", base.top_k)),
        strict_pool=int(strict_pool or own.get("strict_rerank_pool_size", base.strict_pool)),
        firewall=firewall(config) if risk else None,
        strict_top_n=int(wall.get("strict_top_n", base.strict_top_n) if strict_top_n is None else strict_top_n),
        risk_pool=int(risk_pool or wall.get("risk_rerank_pool_size", base.risk_pool)),
        calibration={**tune, **({"reference_year": year} if year else {})} if calibrate else None,
        calibration_pool=int(calibration_pool or tune.get("calibration_pool_size", base.calibration_pool)),
        weights=own.get("score_weights") or {},
        penalties=own.get("penalties") or {},
        semantic=config.get("semantic_matching"),
        snippets=int(own.get("max_evidence_snippets", base.snippets)),
    )
