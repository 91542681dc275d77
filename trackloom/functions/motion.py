"""Motion and measurement models as column expressions: gates, covariances, predictions, likelihoods, and vectors in the plane."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared distances that a share of all matches of two coordinates lies within.
GATES = ((0.997, 11.829), (0.995, 10.597), (0.99, 9.210))
LEAST_GATE = 5.991


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(as_column(high), F.greatest(as_column(low), x))


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """(1, 0) for a vector without length."""
    n = norm(x, y)
    return F.when(n < 1e-9, 1.0).otherwise(x / n), F.when(n < 1e-9, 0.0).otherwise(y / n)


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def gate_of(share: Column) -> Column:
    """The squared distance that belongs to the largest share of the table which is not above this one; at least the smallest."""
    out = F.lit(LEAST_GATE)
    for p, gate in reversed(GATES):
        out = F.when(share >= p, gate).otherwise(out)
    return out


def largest_eigenvalue(sxx: Column, sxy: Column, syy: Column) -> Column:
    return (sxx + syy) / 2 + F.sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)


def safe_radius(gate: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """No pair within the gate is farther apart than this."""
    return F.sqrt(F.greatest(F.lit(0.0), gate * F.greatest(F.lit(1e-12), largest_eigenvalue(sxx, sxy, syy))))


def heading_covariance(along: Column, across: Column, vx: Column, vy: Column, least_speed: float) -> dict[str, Column]:
    """Measurement noise with one deviation along the way and one across; below least_speed the one across holds both ways."""
    ux, uy = unit(vx, vy)
    extra = F.when(norm(vx, vy) < least_speed, 0.0).otherwise(along * along - across * across)
    return {"sxx": across * across + extra * ux * ux, "sxy": extra * ux * uy, "syy": across * across + extra * uy * uy}


def predicted(model: str, dt: Column, p: Column, v: Column, a: Column, keep: float = 0.5) -> dict[str, Column]:
    """Place, speed and acceleration of one axis after dt. 'still' keeps a share of the speed, 'steady' all of it, 'driven' accelerates."""
    zero = F.lit(0.0)
    if model == "still":
        return {"p": p, "v": v * keep, "a": zero}
    if model == "steady":
        return {"p": p + v * dt, "v": v, "a": zero}
    if model == "driven":
        return {"p": p + v * dt + a * dt * dt / 2, "v": v + a * dt, "a": a}
    raise ValueError(f"unknown model {model!r}")


def process_noise(q: Column | float, dt: Column) -> Column:
    """A variance that is added in dt by noise of deviation q a second."""
    q = q if isinstance(q, Column) else F.lit(float(q))
    return q * q * F.greatest(dt, F.lit(1e-9))


def log_likelihood(d2: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """Of an innovation with that squared distance under that covariance, but for a constant."""
    return -(F.log(sxx * syy - sxy * sxy) + d2) / 2


def coast_window(evidence: Column, confirmed_at: float, least: float, most: float, gamma: float) -> Column:
    """Seconds that a track is shown after it was last seen; grows with its evidence."""
    return least + (most - least) * F.pow(clamp((evidence - confirmed_at) / (1 - confirmed_at), 0, 1), F.lit(gamma))


def moved_to(box: Column, cx: Column, cy: Column, cz: Column | None = None) -> Column:
    """A box struct with another centre and the same shape."""
    box = box.withField("cx", cx).withField("cy", cy)
    return box if cz is None else box.withField("cz", cz)
