"""Time integrators as tables of coefficients, stage names, and time-step control."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

LARGE = sys.float_info.max


@dataclass(frozen=True)
class LowStorage:
    """u0 <- gam0 u0 + gam1 u1 + beta dt F(u0), after u1 <- u1 + delta u0; c: times of the stages."""

    delta: tuple[float, ...]
    beta: tuple[float, ...]
    gam0: tuple[float, ...]
    gam1: tuple[float, ...]
    c: tuple[float, ...]

    @property
    def stages(self) -> int:
        return len(self.beta)

    def step(self, u: float, t: float, dt: float, f: Callable[[float, float], float]) -> float:
        u0, u1 = u, 0.0
        for k in range(self.stages):
            slope = f(t + self.c[k] * dt, u0)
            u1 = u1 + self.delta[k] * u0
            u0 = self.gam0[k] * u0 + self.gam1[k] * u1 + self.beta[k] * dt * slope
        return u0


@dataclass(frozen=True)
class Butcher:
    """Explicit Runge-Kutta by its tableau."""

    a: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]
    c: tuple[float, ...]

    @property
    def stages(self) -> int:
        return len(self.b)

    def step(self, u: float, t: float, dt: float, f: Callable[[float, float], float]) -> float:
        slopes: list[float] = []
        for row, c in zip(self.a, self.c, strict=True):
            slopes.append(f(t + c * dt, u + dt * sum(w * k for w, k in zip(row, slopes, strict=False))))
        return u + dt * sum(w * k for w, k in zip(self.b, slopes, strict=True))


#: Low-storage schemes. Fixed values; the five-stage one is SSPRK(5)4 of Ketcheson (2010).
LOW_STORAGE = {
    "rk1": LowStorage((1.0,), (1.0,), (0.0,), (1.0,), (0.0,)),
    "rk2": LowStorage((1.0, 0.0), (1.0, 0.5), (0.0, 0.5), (1.0, 0.5), (0.0, 1.0)),
    "vl2": LowStorage((1.0, 0.0), (0.5, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.5)),
    "rk3": LowStorage((1.0, 0.0, 0.0), (1.0, 0.25, 2 / 3), (0.0, 0.25, 2 / 3), (1.0, 0.75, 1 / 3), (0.0, 1.0, 0.5)),
    "rk4": LowStorage(
        (1.0, 0.0, 0.0, 0.0, 0.0),
        (0.357534921136978, 2.364680399061355, 0.016239790859612, 0.498173799587251, 0.433334235669763),
        (0.0, -3.666545952121251, 0.035802535958088, 4.398279365655791, 0.770411587328417),
        (1.0, 4.666545952121251, 0.964197464041912, -3.398279365655790, 0.229588412671583),
        (0.0, 0.357534921136978, 1.0537621812245777, 0.05396714924417825, 0.7355363985311864),
    ),
}

#: Tableaux. Fixed values; rk2 is the midpoint scheme, which is of second order.
BUTCHER = {
    "rk1": Butcher(((0.0,),), (1.0,), (0.0,)),
    "rk2": Butcher(((0.0, 0.0), (0.5, 0.0)), (0.0, 1.0), (0.0, 0.5)),
    "rk4": Butcher(((0.0,) * 4, (0.5, 0.0, 0.0, 0.0), (0.0, 0.5, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)), (1 / 6, 1 / 3, 1 / 3, 1 / 6), (0.0, 0.5, 0.5, 1.0)),
}

#: The tenth-order scheme of 17 stages. Times, weights, and by stage the slopes it uses.
_RK10_C = (
    0.0,
    0.1,
    0.5393578408029818,
    0.8090367612044727,
    0.30903676120447265,
    0.9810741902197953,
    0.8333333333333334,
    0.3540173658568024,
    0.8825276619647323,
    0.6426157582403226,
    0.3573842417596775,
    0.11747233803526766,
    0.8333333333333334,
    0.30903676120447265,
    0.5393578408029818,
    0.1,
    1.0,
)
_RK10_B = (
    0.03333333333333333,
    0.025,
    0.03333333333333333,
    0.0,
    0.05,
    0.0,
    0.04,
    0.0,
    0.1892374781489235,
    0.2774291885177432,
    0.2774291885177432,
    0.1892374781489235,
    -0.04,
    -0.05,
    -0.03333333333333333,
    -0.025,
    0.03333333333333333,
)
_RK10_A = {
    1: {0: 0.1},
    2: {0: -0.9151765613752915, 1: 1.4545344021782731},
    3: {0: 0.20225919030111816, 2: 0.6067775709033545},
    4: {0: 0.18402471470864357, 2: 0.19796683122719236, 3: -0.07295478473136326},
    5: {0: 0.08790073402066813, 3: 0.41045970252026065, 4: 0.4827137536788665},
    6: {0: 0.08597005049024603, 3: 0.3308859630407222, 4: 0.4896629573094502, 5: -0.07318563750708508},
    7: {0: 0.12093044912533372, 4: 0.2601246757582956, 5: 0.032540262154909134, 6: -0.0595780211817361},
    8: {0: 0.11085437958039149, 5: -0.06057614882550056, 6: 0.3217637056017784, 7: 0.510485725608063},
    9: {0: 0.112054414752879, 5: -0.14494277590286592, 6: -0.3332697190962567, 7: 0.4992692295568801, 8: 0.5095046089296861},
    10: {0: 0.11397678396418598, 5: -0.07688133642033569, 6: 0.23952736032439065, 7: 0.3977746623680946, 8: 0.010755895687360746, 9: -0.3277691241640189},
    11: {0: 0.07983145282801961, 5: -0.052032968680060306, 6: -0.05769541461685489, 7: 0.19478191571210415, 8: 0.14538492318832508, 9: -0.07829427103516708, 10: -0.11450329936109892},
    12: {0: 0.9851156101648573, 3: 0.3308859630407222, 4: 0.4896629573094502, 5: -1.3789648657484357, 6: -0.8611641950276356, 7: 5.784288136375372, 8: 3.2880776198510357, 9: -2.386339050931364, 10: -3.254793424836439, 11: -2.16343541686423},
    13: {0: 0.8950802957716328, 2: 0.19796683122719236, 3: -0.07295478473136326, 5: -0.8512362396620076, 6: 0.3983201123185333, 7: 3.639372631810356, 8: 1.5482287703983033, 9: -2.122217147040537, 10: -1.5835039854532618, 11: -1.7156160828593627, 12: -0.024403640575012746},
    14: {0: -0.9151765613752915, 1: 1.4545344021782731, 4: -0.7773336436449683, 6: -0.0910895662155176, 12: 0.0910895662155176, 13: 0.7773336436449683},
    15: {0: 0.1, 2: -0.15717866579977116, 14: 0.15717866579977116},
    16: {0: 0.1817813007000953, 1: 0.675, 2: 0.3427581598471898, 4: 0.25911121454832275, 5: -0.35827896671795206, 6: -1.0459489594088331, 7: 0.930327845415627, 8: 1.7795095943170811, 9: 0.1, 10: -0.2825475695390441, 11: -0.15932735011997254, 12: -0.14551589464700151, 13: -0.25911121454832275, 14: -0.3427581598471898, 15: -0.675},
}
BUTCHER["rk10"] = Butcher(tuple(tuple(_RK10_A.get(i, {}).get(j, 0.0) for j in range(17)) for i in range(17)), _RK10_B, _RK10_C)


def stage_names(stages: int) -> list[str]:
    """Names of the containers that stages read and write: the base, numbers between, the base."""
    return ["base", *map(str, range(1, stages)), "base"]


@dataclass
class StepControl:
    """The next time step: forced, or what blocks allow within growth, user's limits, floor and ceiling; it lands on the end."""

    tlim: float = LARGE
    factor: float = 2.0
    dt_init: float = LARGE
    init_force: bool = False
    dt_user: float = LARGE
    dt_floor: float = 0.0
    dt_ceil: float = LARGE
    dt_force: float = 0.0
    dt_min: float = 0.0
    dt_min_count_max: int = 1
    dt_max: float = LARGE
    dt_max_count_max: int = 1
    below: int = 0
    above: int = 0

    def next(self, time: float, cycle: int, dt: float, allowed: Sequence[float]) -> float:
        if self.dt_force > 0:
            dt = self.dt_force
        elif cycle == 0 and self.init_force and 0 < self.dt_init < LARGE:
            dt = self.dt_init
        else:
            if dt < 0.1 * LARGE:
                dt *= self.factor
            if cycle == 0:
                dt = min(dt, self.dt_init)
            dt = min([dt, *allowed, self.dt_user])
            dt = max(self.dt_floor, min(dt, self.dt_ceil))
        self.below = self.below + 1 if dt <= self.dt_min else 0
        self.above = self.above + 1 if dt >= self.dt_max else 0
        if self.below and self.below >= self.dt_min_count_max:
            raise RuntimeError(f"the time step is at most {self.dt_min} for {self.below} steps")
        if self.above and self.above >= self.dt_max_count_max:
            raise RuntimeError(f"the time step is at least {self.dt_max} for {self.above} steps")
        if time < self.tlim and self.tlim - time < dt:
            dt = self.tlim - time
        return dt
