"""A generated flow data set with the full header: planted signal, near-duplicate and constant
columns, and a few extreme rows."""

from __future__ import annotations

import numpy as np
import pandas as pd

from flowsieve import presets
from flowsieve.sources.flows import FLOW_SCHEMA

ROWS = 2000
EXTREMES = 5
PLANTED = ["Init Bwd Win Byts", "Fwd Act Data Pkts", "Active Min"]
TWINS = {
    "Subflow Fwd Pkts": "Tot Fwd Pkts",
    "Subflow Bwd Pkts": "Tot Bwd Pkts",
    "Idle Max": "Idle Mean",
    "URG Flag Cnt": "Bwd URG Flags",
}
ATTACKS = ["Probe", "DDoS", "DDoS ", "DoS", "BFA", "Web-Attack", "BOTNET", "U2R"]


def flow_frame(seed: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    attack = rng.random(ROWS) < 0.4
    out = {c: rng.gamma(2.0, 50.0, ROWS) for c in presets.MEASUREMENTS}
    for column in PLANTED:
        out[column] = out[column] + np.where(attack, 150.0, 0.0)
    for copy, original in TWINS.items():
        out[copy] = out[original] * 2 + rng.normal(0, 0.01, ROWS)
    extreme = rng.choice(ROWS, EXTREMES, replace=False)
    for column in presets.GROUP_1:
        out[column][extreme] = 1e6 + rng.random(EXTREMES)
    for column in presets.DROP_CONSTANT[1:]:
        out[column] = np.zeros(ROWS)
    labels = np.where(attack, rng.choice(ATTACKS, ROWS), "Normal")
    stamps = pd.Timestamp("2020-01-03") + pd.to_timedelta(rng.integers(0, 20 * 86400, ROWS), unit="s")
    subnets = ["192.168.8.", "192.168.3.", "200.175.2.", "192.168.20.", "172.17.0.", "10.0.0."]
    out |= {
        "Flow ID": [f"flow-{i}" for i in range(ROWS)],
        "Src IP": [s + str(i % 250) for i, s in enumerate(rng.choice(subnets, ROWS))],
        "Dst IP": [s + str(i % 250) for i, s in enumerate(rng.choice(subnets, ROWS))],
        "Src Port": rng.integers(1024, 65535, ROWS),
        "Dst Port": rng.integers(1, 1024, ROWS),
        "Protocol": rng.choice([6, 17], ROWS),
        "Timestamp": stamps.strftime("%d/%m/%Y %I:%M:%S %p"),
        "Label": labels,
    }
    frame = pd.DataFrame(out)[[f.name for f in FLOW_SCHEMA]]
    frame.attrs["extreme"] = sorted(f"flow-{i}" for i in extreme)
    return frame


def write_flow_files(folder) -> dict[str, str]:
    """Three files, each with its own column order."""
    frame = flow_frame()
    rng = np.random.default_rng(3)
    paths = {}
    for name, part in zip(["attacked", "plain", "switch"], np.array_split(np.arange(ROWS), 3)):
        path = str(folder / f"{name}.csv")
        frame.iloc[part][list(rng.permutation(frame.columns))].to_csv(path, index=False)
        paths[name] = path
    return paths
