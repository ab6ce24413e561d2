"""Hits of one camera: the ball is followed frame by frame, the rest are columns over the frames and a walk over the few claims."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd

from visorlake.operators.ball import next_place

# Fixed values of the online rules, on a 640-pixel square. Keys end in _s for seconds, _d for ball diameters, _dps for diameters a second.
ONLINE = dict(
    width=640.0, rest_dps=7.5, rest_s=0.17, hold_s=1.5, club_d=3.5, club_s=3.0, launch_d=5.0, launch_s=1.0, grow=1.3, gone_s=0.27, near_d=3.0,
    depart_dps=9.0, watch_s=1.0, watch_frac=0.25, return_d=3.0, look_s=2.0, edge_d=1.5, exit_frac=0.22, drift_d=1.0, cooldown_s=2.5, gate_dps=150.0,
    gate_most_d=8.0, reacquire_d=2.5, gap_s=0.15, lost_s=2.0, dwell_s=0.4, dwell_window_s=3.0, touch_d=0.8, r_most=58 / 2048 * 640, r_least=5 / 2048 * 640,
    apart_d=1.0)
#: Columns of a followed ball. `born` is -1 without a ball; `gap` and `seen` are the seconds since and the time of the sighting before this frame; (`ox`, `oy`)
#: is what the camera moved since the ball's first frame; `rate` is -1 unless the ball was seen in the frame before too; `club` is the distance of the nearest club.
FOLLOWED = dict(t="long", born="long", missing="int", gap="double", seen="long", x="double", y="double", r="double", ox="double", oy="double", rate="double", club="double")
#: What goes on from one piece of the frames to the next: the claim that is open, and the ball over the last seconds.
MEMORY = ("count int, fired double, reset long, judged long, start double, fire double, rolled boolean, cut boolean, spot_x double, spot_y double, spot_r double, near double, "
          + ", ".join(f"{k} array<{v}>" for k, v in FOLLOWED.items()))
NONE, FAR = -1, 1e9


def follow(past: pd.DataFrame, frames: pd.DataFrame, c: dict) -> pd.DataFrame:
    """`past` and the followed ball of `frames`: ts, bx, by, br (candidates), kx, ky (clubs), dx, dy, in order."""
    life, last = None, dict(past.iloc[-1]) if len(past) else None
    seen = int(last["seen"] if last["missing"] or last["born"] == NONE else last["t"]) if last else NONE
    if last and last["born"] != NONE:
        life = dict(born=int(last["born"]), map=[1.0, 0.0, last["ox"], 0.0, 1.0, last["oy"]], x=last["x"], y=last["y"], r=last["r"], missing=int(last["missing"]))
    out = []
    for t, bx, by, br, kx, ky, dx, dy in zip(*(frames[k] for k in ("ts", "bx", "by", "br", "kx", "ky", "dx", "dy")), strict=True):
        gap, old = (t - seen) / 1e9 if seen != NONE else 0.0, life
        found = list(zip(bx, by, br, strict=True))
        life = next_place(life, t, found, [1.0, 0.0, dx, 0.0, 1.0, dy], min(c["gate_dps"] * gap, c["gate_most_d"]), c["reacquire_d"], 1 << 30)
        if life and life["missing"] and gap > c["lost_s"]:
            life = None
        if life is None:
            out.append((t, NONE, 0, gap, seen, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0, FAR))
            continue
        x, y, D, (ox, oy) = life["x"], life["y"], 2 * life["r"], life["map"][2::3]
        rate, club = -1.0, FAR
        if not life["missing"]:
            if old and not old["missing"] and gap > 0:
                rate = math.hypot(x - ox - old["x"] + old["map"][2], y - oy - old["y"] + old["map"][5]) / D / gap
            club = min((math.hypot(a - x, b - y) / D for a, b in zip(kx, ky, strict=True)), default=FAR)
        out.append((t, life["born"], life["missing"], gap, seen, x, y, life["r"], ox, oy, rate, club))
        seen = seen if life["missing"] else t
    now = pd.DataFrame(out, columns=list(FOLLOWED))
    return pd.concat([past, now], ignore_index=True) if len(past) else now


class Address:
    """Where the ball rested lately and whether a club was at it, for every frame, as columns."""

    def __init__(self, ball: pd.DataFrame, c: dict):
        self.c, self.rows = c, np.arange(len(ball))
        for k in FOLLOWED:
            setattr(self, k, ball[k].to_numpy())
        self.s, self.seen_s = self.t / 1e9, self.seen / 1e9
        self.here = self.x - self.ox, self.y - self.oy                          # in the picture of the ball's first frame
        self.sighted = (self.born != NONE) & (self.missing == 0)
        self.slow = (self.rate >= 0) & (self.rate < c["rest_dps"]) & (self.gap <= c["gap_s"])
        fresh = np.append(True, self.born[1:] != self.born[:-1])
        self.broken = np.maximum.accumulate(np.where(fresh | self.sighted & ((self.gap > c["gap_s"]) | (self.rate >= c["rest_dps"])), self.rows, 0))
        at_club = self.sighted & (self.club < c["club_d"])
        self.dwelt = np.append(0.0, np.cumsum(np.where(at_club, np.minimum(self.gap, c["gap_s"]), 0.0)))
        self.touched = np.append(0, np.cumsum(at_club & (self.club <= c["touch_d"])))
        with_club = np.maximum.accumulate(np.where(at_club, self.rows, NONE))
        self.with_club = (with_club != NONE) & (self.s - self.s[with_club] <= c["club_s"])
        paced = np.maximum.accumulate(np.where(self.rate >= 0, self.rows, NONE))
        self.pace = np.where(paced == NONE, 0.0, self.rate[paced])
        self.lost = (self.born != NONE) & (self.missing > 0) & (self.s - self.seen_s >= c["gone_s"])

    def since(self, row: int) -> None:
        """Rest counts from `row` on: `spot` is the frame of the latest rest, `armed` whether that is recent, `launched` whether the ball has just left it."""
        c, n = self.c, len(self.rows)
        later = np.append(np.minimum.accumulate(np.where(self.slow, self.rows, n)[::-1])[::-1], n)
        first = np.minimum(later[np.maximum(self.broken, row)], n - 1)          # the slow frame with which the run began
        rest = self.slow & (self.rows >= row) & (self.s - (self.s - self.gap)[first] >= c["rest_s"])
        spot = np.maximum.accumulate(np.where(rest, self.rows, NONE))
        held = (spot != NONE) & (self.born != NONE) & (self.born[spot] == self.born)
        self.spot, age = spot, self.s - self.s[spot]
        self.armed = held & (age <= c["hold_s"])
        self.away = np.hypot(self.here[0] - self.here[0][spot], self.here[1] - self.here[1][spot]) / (2 * self.r[spot])
        self.launched = self.sighted & (age <= c["launch_s"]) & (self.away >= c["launch_d"]) & (self.r <= c["grow"] * self.r[spot])

    def club_dwelt(self, row: int) -> bool:
        """Whether a club stayed at the ball, or touched it, in the seconds before it was last seen."""
        lo, hi = np.searchsorted(self.s, self.seen_s[row] - self.c["dwell_window_s"]), np.searchsorted(self.t, self.seen[row], "right")
        return bool(self.dwelt[hi] - self.dwelt[lo] >= self.c["dwell_s"] - 1e-9 or self.touched[hi] > self.touched[lo])

    def carried_out(self, row: int) -> bool:
        """Whether the camera took the missing ball out of the picture, by how it moved since the ball was last seen; over the lower border is the head's lift."""
        c, W, D = self.c, self.c["width"], 2 * self.r[self.spot[row]]
        last = int(np.searchsorted(self.t, self.seen[row], "right")) - 1
        place = np.array([self.x[last], self.y[last]])
        drift = np.array([self.x[row], self.y[row]]) - place
        length = float(np.hypot(*drift))
        if length < c["drift_d"] * D:
            return False
        room = np.where(drift > 0, W - place, place)                            # up to the border ahead, across and down
        ahead = np.where(np.abs(drift) > 1e-9 * length, room * length / np.maximum(np.abs(drift), 1e-12), np.inf)
        lifted = ahead[1] < ahead[0] and drift[1] > abs(drift[0])
        return not lifted and bool(ahead.min() < c["exit_frac"] * W or min(*place, *(W - place)) < c["edge_d"] * D)


def _claim(a: Address, row: int) -> tuple[dict | None, bool]:
    """The claim that `row` makes, and whether what rested there is forgotten instead."""
    p, c = a.spot[row], a.c
    fire, rolled = a.s[p], bool(a.sighted[row])
    if not rolled and a.away[row] > c["near_d"]:
        if a.pace[row] < c["depart_dps"]:
            return None, False
    elif not rolled:
        if not a.club_dwelt(row):
            return None, False
        if a.carried_out(row):
            return None, True
        fire = a.seen_s[row]
    return dict(start=float(a.s[row]), fire=float(fire), rolled=rolled, cut=False, spot_x=float(a.here[0][p] + a.ox[row]), spot_y=float(a.here[1][p] + a.oy[row]),
                spot_r=float(a.r[p]), near=0.0), False


def _follow_up(a: Address, frames: pd.DataFrame, lo: int, first: int, claim: dict) -> tuple[int | None, bool]:
    """The frame from `first` on in which the claim is decided, and whether it stands. `claim` is brought up to that frame or the last one."""
    c, rows = a.c, slice(first, None)
    s, new = a.s[rows], a.s[rows] > claim["start"]
    step = np.where(new, np.diff(a.s, prepend=a.s[0])[rows], 0.0)
    sx, sy = (np.cumsum(np.append(claim[f"spot_{k}"], np.where(new, frames[f"d{k}"].to_numpy()[first - lo:], 0.0)))[1:] for k in "xy")
    reach = c["return_d"] * 2 * claim["spot_r"]
    if claim["rolled"]:
        cut = claim["cut"] | np.logical_or.accumulate(new & a.sighted[rows] & (a.gap[rows] > c["gap_s"]))
        good = ~(a.sighted[rows] & ~cut & (np.hypot(a.x[rows] - sx, a.y[rows] - sy) < reach))
        near, over = np.zeros(len(s)), ~good | (s - claim["fire"] >= c["look_s"])
    else:
        until = min(int(np.searchsorted(s, claim["start"] + c["watch_s"])) + 2, len(s))
        held = np.zeros(len(s), bool)
        for i in range(until):
            f = frames.iloc[first - lo + i]
            held[i] = any(math.hypot(x - sx[i], y - sy[i]) < reach for x, y in zip(f["bx"], f["by"], strict=True))
        near = np.cumsum(np.append(claim["near"], step * held))[1:]
        cut, over = np.zeros(len(s), bool), s - claim["start"] >= c["watch_s"]
        good = near < c["watch_frac"] * (s - claim["start"])
    end = int(over.argmax()) if over.any() else None
    at = -1 if end is None else end
    claim.update(cut=bool(cut[at]), spot_x=float(sx[at]), spot_y=float(sy[at]), near=float(near[at]))
    return None if end is None else first + end, bool(good[at])


def hit_states(memory: dict | None, frames: pd.DataFrame, c: dict = ONLINE) -> tuple[pd.DataFrame, dict]:
    """Count, state (SEARCH, TRACK, ADDRESS, PEND), whether a hit was counted and when it was, for each frame; and what to remember.

    A ball that rested with a club near and then launches or vanishes makes a claim. A launch stands unless the ball is back at its spot soon; a ball that
    vanished stands if hardly anything is seen at its spot for a while. What rested before a claim was decided does not count again.
    """
    m = memory or dict(count=0, fired=None, reset=None, judged=None, start=None) | {k: [] for k in FOLLOWED}
    claim = {k: m[k] for k in ("start", "fire", "rolled", "cut", "spot_x", "spot_y", "spot_r", "near")} if m["start"] is not None else None
    past = pd.DataFrame({k: m[k] for k in FOLLOWED})
    lo, count, fired, judged, reset = len(past), m["count"], m["fired"], m["judged"], m["reset"]
    ball = follow(past, frames, c)
    a = Address(ball, c)
    n, row = len(ball), lo
    a.since(0 if reset is None else int(np.searchsorted(a.t, reset, "right")))
    armed, pending, hits = a.armed.copy(), np.zeros(n, bool), {}
    while row < n:
        if claim is None:
            free = a.armed & a.with_club & (a.launched | (a.lost & (a.seen != (NONE if judged is None else judged))))
            rows = np.flatnonzero(free[row:] & ((a.s[row:] - fired >= c["cooldown_s"]) if fired is not None else True))
            if not len(rows):
                break
            row += int(rows[0])
            judged = judged if a.sighted[row] else int(a.seen[row])
            claim, forget = _claim(a, row)
            if claim is None:
                row += 1
                if forget:
                    reset = int(a.t[row - 1])
                    a.since(row)
                    armed[row:] = a.armed[row:]
                continue
        end, good = _follow_up(a, frames, lo, row, claim)
        pending[row:end] = True
        if end is None:
            break
        if good and (fired is None or claim["fire"] - fired >= c["cooldown_s"]):
            fired, count = claim["fire"], count + 1
            hits[end] = fired
        claim, reset, row = None, int(a.t[end]), end + 1
        a.since(row)
        armed[row:] = a.armed[row:]
    at = pd.Series(hits, dtype=float).reindex(range(lo, n))
    out = pd.DataFrame({"count": (m["count"] + at.notna().cumsum()).to_numpy(), "fired": at.notna().to_numpy(), "fire_s": at.astype(object).where(at.notna(), None).to_numpy(),
                        "state": np.select([pending, armed, a.sighted], ["PEND", "ADDRESS", "TRACK"], "SEARCH")[lo:]})
    tail = ball[a.s >= a.s[-1] - c["lost_s"] - c["dwell_window_s"] - 0.5]
    open_ = claim or dict.fromkeys(("start", "fire", "rolled", "cut", "spot_x", "spot_y", "spot_r", "near"))
    return out, dict(count=int(count), fired=fired, reset=reset, judged=judged, **open_) | {k: tail[k].tolist() for k in FOLLOWED}
