"""When somebody stands ready: runs of frames in posture, as columns over a camera's frames in order."""
from __future__ import annotations

import numpy as np
import pandas as pd

NS = 1_000_000_000
#: Seconds a posture is held, how far the hip may move meanwhile, lean of the back, seconds a low club counts, seconds away before the next prompt.
POSTURE = dict(hold_s=0.4, still=0.04, lean=0.30, club_s=1.0, away_s=0.6)
#: What goes on from one piece of the frames to the next.
MEMORY = ("club long, posture boolean, begun long, ok_at long, away_at long, said string, hip_t array<long>, hip_x array<double>, hip_y array<double>")
NEVER = np.iinfo(np.int64).min // 2


def _latest(at: np.ndarray, hit: np.ndarray, before: int) -> np.ndarray:
    """The last time of a hit up to each row."""
    return np.maximum(np.maximum.accumulate(np.where(hit, at, NEVER)), before)


def _spread(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest minus smallest value from row `first` to each row; the windows are a few frames long."""
    at = np.arange(len(values))
    high, low = values.copy(), values.copy()
    for back in range(1, int((at - first).max(initial=0)) + 1):
        rows = at[at - back >= first]
        high[rows], low[rows] = np.maximum(high[rows], values[rows - back]), np.minimum(low[rows], values[rows - back])
    return high - low


def posture_states(memory: dict | None, frames: pd.DataFrame, c: dict = POSTURE) -> tuple[pd.DataFrame, dict]:
    """State (SEARCHING, HUMAN, POSTURE, PROMPT) of each frame and whether a prompt begins there; and what to remember.

    `frames`, in order: ts in nanoseconds, person, leaning, club_low, hip_x, hip_y. A frame is in posture if the back leans and a club was low
    lately. Frames fall into runs in and out of posture. A run in posture with a still hip for long enough gives a prompt, unless
    there was one since the last run out of posture that went on for long enough to count as away; until then the state of the
    posture before stays.
    """
    m = memory or dict(club=None, posture=None, begun=None, ok_at=None, away_at=None, said=None, hip_t=[], hip_x=[], hip_y=[])
    old = lambda k: NEVER if m[k] is None else m[k]
    t, person = frames["ts"].to_numpy(np.int64), frames["person"].to_numpy(bool)
    hold, away_ns = round(c["hold_s"] * NS), round(c["away_s"] * NS)
    club = _latest(t, frames["club_low"].to_numpy(bool), old("club"))
    posture = frames["leaning"].to_numpy(bool) & (t - club <= round(c["club_s"] * NS))

    change = np.append(posture[:1] != m["posture"], posture[1:] != posture[:-1])
    start = np.maximum.accumulate(np.where(change, np.arange(len(t)), -1))     # row where the run began, -1 if before these frames
    begun = np.where(start >= 0, t[start], old("begun"))

    kept = len(m["hip_t"])                                                     # hips of the run so far stand before these frames
    at = np.append(np.array(m["hip_t"], np.int64), t)
    first = np.maximum(np.searchsorted(at, t - hold), np.where(start >= 0, start + kept, 0))
    window = np.append(np.arange(kept), first)
    xs, ys = (np.append(np.array(m[k], float), frames[k].to_numpy(float)) for k in ("hip_x", "hip_y"))
    moved = np.maximum(_spread(xs, window), _spread(ys, window))[kept:]
    ok = posture & (np.arange(kept, kept + len(t)) - first >= 2) & (moved <= c["still"]) & (t - begun >= hold)

    away = ~posture & (t - begun >= away_ns)
    away_at = _latest(t, away, old("away_at"))
    ok_at = _latest(t, ok, old("ok_at"))
    ok_before = np.append(old("ok_at"), ok_at[:-1])
    told = ok_at > away_at
    last = np.maximum.accumulate(np.where(posture, np.arange(len(t)), -1))
    said = np.where(last >= 0, np.where(told[last], "PROMPT", "POSTURE"), m["said"] or "")
    name = np.where(away | (said == ""), np.where(person, "HUMAN", "SEARCHING"), said)

    none = lambda v: None if v == NEVER else int(v)
    tail = slice(int(np.searchsorted(at, t[-1] - hold)) if start[-1] < 0 else max(int(np.searchsorted(at, t[-1] - hold)), int(start[-1]) + kept), None)
    hips = (at[tail].tolist(), xs[tail].tolist(), ys[tail].tolist()) if posture[-1] else ([], [], [])
    out = pd.DataFrame({"state": name, "confirmed": ok & (ok_before <= away_at)})
    return out, dict(club=none(club[-1]), posture=bool(posture[-1]), begun=none(begun[-1]), ok_at=none(ok_at[-1]), away_at=none(away_at[-1]),
                     said=str(said[-1]) or None, hip_t=hips[0], hip_x=hips[1], hip_y=hips[2])
