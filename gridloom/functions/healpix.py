"""HEALPix index arithmetic as integer column expressions.

Pixels lie on a plane of tilted squares (Gorski et al. 2005): p counts half pixels eastward along a ring of the equatorial belt, v half
pixels northward from the equator. Each of 12 faces is a square of nside x nside cells, x to the north-east, y to the north-west, whose
centre has p = nside (2 q + 1), v = +-nside near the poles and p = 2 nside q, v = 0 at the equator, for q = 0..3. So a face is found
by integer division of p + v and v - p, and near the poles by the quarter of the ring. Indices are long; nside is a Python number,
a power of 2 up to 2^29 where nested indices are used. Intermediate results are bound to lambda variables, so each is evaluated once and expressions stay small when nested.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def nside_of(npix: int) -> int:
    """The nside with so many pixels."""
    nside = math.isqrt(npix // 12)
    if 12 * nside * nside != npix:
        raise ValueError(f"{npix} is no number of pixels")
    return nside


def npix_of(nside: int) -> int:
    return 12 * nside * nside


def order_of(nside: int) -> int:
    """Log2 of nside, which must be a power of 2."""
    if nside < 1 or nside & (nside - 1):
        raise ValueError(f"{nside} is no power of 2")
    return nside.bit_length() - 1


def _n(x: int) -> Column:
    return F.lit(x).cast("long")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.transform(F.array(x), lambda c: f(c))[0]


def _div(a: Column, n: Column) -> Column:
    """Floor division."""
    return F.call_function("div", a - F.pmod(a, n), n)


def isqrt(a: Column) -> Column:
    """Integer root of a long, also where doubles are too coarse."""
    root = F.floor(F.sqrt(a.cast("double"))).cast("long")
    return let(root, lambda r: r - (r * r > a).cast("long") + ((r + 1) * (r + 1) <= a).cast("long"))


def spread_bits(a: Column, order: int) -> Column:
    """The lowest bits moved to the even places."""
    out = _n(0)
    for b in range(order):
        out = out + F.shiftleft(F.shiftright(a, b).bitwiseAND(_n(1)), 2 * b)
    return out


def compress_bits(a: Column, order: int) -> Column:
    """The even bits moved together; the odd ones are dropped."""
    out = _n(0)
    for b in range(order):
        out = out + F.shiftleft(F.shiftright(a, 2 * b).bitwiseAND(_n(1)), b)
    return out


def _cell(face: Column, x: Column, y: Column) -> Column:
    return F.struct(face.cast("long").alias("face"), x.cast("long").alias("x"), y.cast("long").alias("y"))


def nest_to_cell(pix: Column, nside: int) -> Column:
    """struct(face, x, y) of a nested index."""
    return let(pix, lambda c: _nest_to_cell(c, nside))


def _nest_to_cell(pix: Column, nside: int) -> Column:
    order = order_of(nside)
    inside = pix.bitwiseAND(_n(nside * nside - 1))
    return _cell(F.shiftright(pix, 2 * order), compress_bits(inside, order), compress_bits(F.shiftright(inside, 1), order))


def cell_to_nest(cell: Column, nside: int) -> Column:
    return let(cell, lambda c: _cell_to_nest(c, nside))


def _cell_to_nest(cell: Column, nside: int) -> Column:
    order = order_of(nside)
    return cell["face"] * nside * nside + spread_bits(cell["x"], order) + 2 * spread_bits(cell["y"], order)


def ring_place(pix: Column, nside: int) -> Column:
    """struct(ring, j) of a ring index: rings from 1 in the north, places from 0 eastward."""
    return let(pix, lambda c: _ring_place(c, nside))


def _ring_place(pix: Column, nside: int) -> Column:
    npix, cap = npix_of(nside), 2 * nside * (nside - 1)
    north = F.shiftright(1 + isqrt(1 + 2 * pix), 1)
    back = npix - 1 - pix
    south = F.shiftright(1 + isqrt(1 + 2 * back), 1)
    belt = pix - cap
    ring = F.when(pix < cap, north).when(back < cap, 4 * nside - south).otherwise(nside + _div(belt, _n(4 * nside)))
    j = F.when(pix < cap, pix - 2 * north * (north - 1)).when(back < cap, 2 * south * (south + 1) - 1 - back).otherwise(F.pmod(belt, _n(4 * nside)))
    return F.struct(ring.alias("ring"), j.alias("j"))


def _quarter(ring: Column, nside: int) -> Column:
    """Pixels in a quarter of a ring."""
    return F.least(ring, 4 * nside - ring, _n(nside))


def _from_plane(gx: Column, gy: Column, nside: int) -> Column:
    """The cell of plane cells gx = (p + v + nside) / 2 and gy = (v - p + nside) / 2, rounded down, in the belt."""
    tx, ty = _div(gx, _n(nside)), _div(gy, _n(nside))
    face = F.when(tx + ty == 0, 4 + F.pmod(tx, _n(4))).when(tx + ty > 0, F.pmod(-ty, _n(4))).otherwise(8 + F.pmod(tx, _n(4)))
    return _cell(face, F.pmod(gx, _n(nside)), F.pmod(gy, _n(nside)))


def ring_to_cell(place: Column, nside: int) -> Column:
    """struct(face, x, y) of `ring_place`."""
    return let(place, lambda c: _ring_to_cell(c, nside))


def _ring_to_cell(place: Column, nside: int) -> Column:
    ring, j = place["ring"], place["j"]
    nr = _quarter(ring, nside)
    q, east = _div(j, nr), 2 * F.pmod(j, nr) - (nr - 1)
    top, low = 2 * nside - 1 - nr, nr - 1
    v = 2 * nside - ring
    p = 2 * j + F.pmod(ring - nside + 1, _n(2))
    belt = _from_plane(_div(p + v + nside, _n(2)), _div(v - p + nside, _n(2)), nside)
    return F.when(ring < nside, _cell(q, F.shiftright(top + east, 1), F.shiftright(top - east, 1))).when(ring > 3 * nside, _cell(8 + q, F.shiftright(low + east, 1), F.shiftright(low - east, 1))).otherwise(belt)


def cell_place(cell: Column, nside: int) -> Column:
    """struct(ring, j) of a cell."""
    return let(cell, lambda c: _cell_place(c, nside))


def _cell_place(cell: Column, nside: int) -> Column:
    face, x, y = cell["face"], cell["x"], cell["y"]
    q, row = F.pmod(face, _n(4)), 1 - _div(face, _n(4))
    ring = 2 * nside - (row * nside + x + y + 1 - nside)
    nr = _quarter(ring, nside)
    centre = nside * F.when(row == 0, 2 * q).otherwise(2 * q + 1)
    cap = q * nr + F.shiftright(x - y + nr - 1, 1)
    return F.struct(ring.alias("ring"), F.when((ring < nside) | (ring > 3 * nside), cap).otherwise(_div(F.pmod(centre + x - y, _n(8 * nside)), _n(2))).alias("j"))


def place_to_ring(place: Column, nside: int) -> Column:
    """The ring index of struct(ring, j)."""
    return let(place, lambda c: _place_to_ring(c, nside))


def _place_to_ring(place: Column, nside: int) -> Column:
    ring, j = place["ring"], place["j"]
    nr = _quarter(ring, nside)
    first = F.when(ring < nside, 2 * nr * (nr - 1)).when(ring > 3 * nside, npix_of(nside) - 2 * nr * (nr + 1)).otherwise(2 * nside * (nside - 1) + (ring - nside) * 4 * nside)
    return first + j


def nest_to_ring(pix: Column, nside: int) -> Column:
    return place_to_ring(cell_place(nest_to_cell(pix, nside), nside), nside)


def ring_to_nest(pix: Column, nside: int) -> Column:
    return cell_to_nest(ring_to_cell(ring_place(pix, nside), nside), nside)


def place_to_angle(place: Column, nside: int) -> Column:
    """struct(z, phi): cosine of the colatitude and longitude of a pixel's centre."""
    return let(place, lambda c: _place_to_angle(c, nside))


def _place_to_angle(place: Column, nside: int) -> Column:
    ring, j = place["ring"], place["j"]
    nr = _quarter(ring, nside)
    cap = 1 - nr * nr / (3.0 * nside * nside)
    z = F.when(ring < nside, cap).when(ring > 3 * nside, -cap).otherwise((2 * nside - ring) * 2 / (3.0 * nside))
    phi = F.when((ring < nside) | (ring > 3 * nside), (2 * j + 1) * math.pi / (4 * nr)).otherwise((2 * j + F.pmod(ring - nside + 1, _n(2))) * math.pi / (4.0 * nside))
    return F.struct(z.alias("z"), phi.alias("phi"))


def angle_to_cell(z: Column, phi: Column, nside: int) -> Column:
    """The cell that holds a direction."""
    turn = F.pmod(phi / (math.pi / 2), F.lit(4.0))
    p, v = turn * (2 * nside), z * (1.5 * nside)
    belt = _from_plane(F.floor((p + v + nside) / 2), F.floor((v - p + nside) / 2), nside)
    q = F.least(F.floor(turn), _n(3))
    t, part = nside * F.sqrt(3 * (1 - F.abs(z))), turn - q
    a, b = F.least(F.floor(t * part), _n(nside - 1)), F.least(F.floor(t * (1 - part)), _n(nside - 1))
    return F.when(F.abs(z) <= 2 / 3, belt).when(z > 0, _cell(q, nside - 1 - b, nside - 1 - a)).otherwise(_cell(8 + q, a, b))


def angle_to_vector(z: Column, phi: Column) -> Column:
    """struct(x, y, z) of unit length."""
    r = F.sqrt(1 - z * z)
    return F.struct((r * F.cos(phi)).alias("x"), (r * F.sin(phi)).alias("y"), z.alias("z"))


def vector_to_angle(x: Column, y: Column, z: Column) -> Column:
    """struct(z, phi) of a vector of any length but zero; null for zero."""
    length = F.sqrt(x * x + y * y + z * z)
    return F.struct((z / F.when(length > 0, length)).alias("z"), F.pmod(F.atan2(y, x), F.lit(2 * math.pi)).alias("phi"))


def neighbours(cell: Column, nside: int) -> Column:
    """The cells around a cell, from the southwest clockwise; at the corners where three faces meet there are seven."""
    steps = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    return let(cell, lambda c: F.filter(F.array(*(_beside(c, dx, dy, nside) for dx, dy in steps)), lambda n: n.isNotNull()))


def _beside(cell: Column, dx: int, dy: int, nside: int) -> Column:
    n, x, y = _n(nside), cell["x"] + dx, cell["y"] + dy
    # over which edges of the face: 3 (east + 1) + north + 1, each -1, 0 or 1
    edge = 3 * _div(x, n) + _div(y, n) + 4
    state = F.struct(edge.alias("edge"), F.pmod(x, n).alias("x"), F.pmod(y, n).alias("y"), F.pmod(cell["face"], _n(4)).alias("q"), _div(cell["face"], _n(4)).alias("row"))
    return let(state, lambda s: _landed(s, nside))


def _landed(s: Column, nside: int) -> Column:
    q, x, y = s["q"], s["x"], s["y"]
    left, right, across = (F.pmod(q + k, _n(4)) for k in (3, 1, 2))
    top, low = _n(nside - 1), _n(0)

    def over(east: int, north: int) -> Column:
        return s["edge"] == 3 * east + north + 4

    polar = (  # around the poles faces turn by a quarter
        F.when(over(1, 0), _cell(right, y, top)).when(over(0, 1), _cell(left, top, x)).when(over(1, 1), _cell(across, top, top))
        .when(over(0, -1), _cell(4 + right, x, y)).when(over(-1, 0), _cell(4 + q, x, y)).when(over(-1, -1), _cell(8 + q, x, y))
    )
    belt = (
        F.when(over(1, 0), _cell(q, x, y)).when(over(0, 1), _cell(left, x, y)).when(over(0, -1), _cell(8 + q, x, y)).when(over(-1, 0), _cell(8 + left, x, y))
        .when(over(1, -1), _cell(4 + right, x, y)).when(over(-1, 1), _cell(4 + left, x, y))
    )
    austral = (
        F.when(over(1, 0), _cell(4 + right, x, y)).when(over(0, 1), _cell(4 + q, x, y)).when(over(1, 1), _cell(q, x, y))
        .when(over(0, -1), _cell(8 + right, low, x)).when(over(-1, 0), _cell(8 + left, y, low)).when(over(-1, -1), _cell(8 + across, low, low))
    )
    return F.when(over(0, 0), _cell(4 * s["row"] + q, x, y)).when(s["row"] == 0, polar).when(s["row"] == 1, belt).otherwise(austral)
