"""Numpy helpers that run inside tasks on one bounded block of a volume."""

import numpy as np
import pandas as pd

BLOCK_CELLS = 1 << 18


#: Steps that are tried one by one before the lower envelope is built.
NEAR = 16


def spread(f, step):
    """min over j of f[j] + (step * (i - j))**2 along axis 0; lines without a finite value stay as they are.

    The nearest places are tried first, all lines at once. Lines with values that a farther place may
    still lower get their lower envelope, so the work per line grows with its length only.
    """
    if f.ndim > 2:
        return spread(f.reshape(len(f), -1), step).reshape(f.shape)
    some = np.isfinite(f).any(0)
    if not some.all():
        out = f.copy()
        if some.any():
            out[:, some] = spread(f[:, some], step)
        return out
    out = f.copy()
    for d in range(1, min(NEAR, len(f) - 1) + 1):
        cost = (step * d) ** 2
        if cost >= out.max(initial=0):
            return out
        np.minimum(out[d:], f[:-d] + cost, out=out[d:])
        np.minimum(out[:-d], f[d:] + cost, out=out[:-d])
    if len(f) > NEAR + 1:
        open_lines = np.flatnonzero(out.max(0) > (step * (NEAR + 1)) ** 2)
        if len(open_lines):
            out[:, open_lines] = envelope(f[:, open_lines], step)
    return out


def envelope(f, step):
    """The same by lower envelopes of the parabolas over all places, every line with a finite value."""
    n, lines = f.shape
    line = np.arange(lines)
    site, begin = np.zeros((n, lines), np.int64), np.full((n, lines), -np.inf)
    top = np.full(lines, -1)
    scaled = f / step ** 2
    for q in range(n):
        own = np.flatnonzero(np.isfinite(f[q]))
        cross = np.full(lines, -np.inf)
        todo = own[top[own] >= 0]
        while len(todo):
            p = site[top[todo], todo]
            at = (scaled[q, todo] - scaled[p, todo] + q * q - p * p) / (2.0 * (q - p))
            hidden = at <= begin[top[todo], todo]  # the last parabola is nowhere least
            cross[todo[~hidden]] = at[~hidden]
            todo = todo[hidden]
            top[todo] -= 1
        top[own] += 1
        site[top[own], own], begin[top[own], own] = q, cross[own]
    out, k = np.empty_like(f), np.zeros(lines, np.int64)
    for q in range(n):
        while True:
            on = np.flatnonzero((k < top) & (begin[np.minimum(k + 1, n - 1), line] < q))
            if not len(on):
                break
            k[on] += 1
        p = site[k, line]
        out[q] = f[p, line] + (step * (q - p)) ** 2
    return out


def plane_distance(at):
    """Squared in-plane distance to the set voxels of each z plane, one row per (z, y)."""
    zs, place = np.unique(at["z"], return_inverse=True)
    ny, nx = int(at["ny"][0]), int(at["nx"][0])
    g = np.full((nx, len(zs), ny), np.inf)
    g[at["x"], place, at["y"]] = 0.0
    g = spread(g, at["dx"][0])
    g = spread(np.ascontiguousarray(g.transpose(2, 1, 0)), at["dy"][0])
    rows = np.ascontiguousarray(g.transpose(1, 0, 2)).reshape(-1, nx)
    return {"z": np.repeat(zs, ny), "y": np.tile(np.arange(ny, dtype="int32"), len(zs)), "g": rows}


def column_distance(at):
    """Distance of each query point (``point``) from the per-plane squared distances of its y planes (the other rows)."""
    point = at["point"]
    z, y, x = (at[k][point] for k in "zyx")
    dist = np.full(len(z), np.nan)
    if len(z) and not point.all():
        low, high = int(at["y"][~point].min()), int(at["y"][~point].max())
        g = np.full((int(at["nz"][0]), high - low + 1, int(at["nx"][0])), np.inf)
        g[at["z"][~point], at["y"][~point] - low] = at["g"].reshape(-1, g.shape[2])
        dist = np.sqrt(spread(g, at["dz"][0]))[z, y - low, x]
    return {"z": z, "y": y, "x": x, "dist": dist}


def stacked(at):
    """Own voxels of a block with the values of the planes before and behind; NaN where there is none."""
    own = at["own"]
    low = [int(at[k].min()) for k in "zyx"]
    a = np.full([int(at[k].max()) - l + 1 for k, l in zip("zyx", low)], np.nan)
    spot = [at[k] - l for k, l in zip("zyx", low)]
    a[tuple(spot)] = at["value"]
    a = np.pad(a, [(1, 1), (0, 0), (0, 0)], constant_values=np.nan)
    z, y, x = (p[own] for p in spot)
    return {**{k: at[k][own] for k in "zyx"}, "prev": a[z, y, x], "cur": a[z + 1, y, x], "next": a[z + 2, y, x]}


def between_planes(place, planes, vz, vy, vx, value):
    """Trilinear values at places (fz, fy, fx) between the voxels of some planes, which increase; beyond the voxels
    all is 0. Planes that are not there are empty. Also the cells of a plane."""
    # a rim of zeros on every side, where all places beyond the voxels are read
    grid = np.zeros((len(planes), vy.max() + 3, vx.max() + 3))
    grid[np.searchsorted(planes, vz), vy + 1, vx + 1] = value
    fz, fy, fx = place.T
    spot = [np.floor(f) for f in (fz, fy, fx)]
    part = [f - s for f, s in zip((fz, fy, fx), spot)]
    level = np.searchsorted(planes, spot[0])
    inside = [np.clip(np.nan_to_num(s) + 1, 0, n - 2).astype(int) for s, n in zip(spot[1:], grid.shape[1:])]
    beyond = [(s < -1) | (s > n - 3) for s, n in zip(spot[1:], grid.shape[1:])]
    total = np.zeros(len(place))
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                weight = np.ones(len(place))
                for share, k in zip(part, (a, b, c)):
                    weight = weight * (share if k else 1.0 - share)
                total += weight * grid[level + a, inside[0] + b, inside[1] + c]
    total[beyond[0] | beyond[1]] = 0.0
    return total, grid[0].size


def uncovered(at):
    """Places of a plane that no other row names; as often as the plane itself is there."""
    plane = at["plane"]
    if not plane.any():
        return {"y": np.zeros(0, np.int32), "x": np.zeros(0, np.int32)}
    shapes = []
    for ny, nx in zip(at["ny"][plane].tolist(), at["nx"][plane].tolist()):
        y, x = at["y"][~plane], at["x"][~plane]
        inside = (y >= 0) & (y < ny) & (x >= 0) & (x < nx)
        free = np.ones((ny, nx), bool)
        free[y[inside], x[inside]] = False
        shapes.append(np.nonzero(free))
    y, x = (np.concatenate(p).astype(np.int32) for p in zip(*shapes))
    return {"y": y, "x": x}


def grown(at, n, size):
    """Cells of a block within ``n`` face steps of the mask; the block comes with the voxels as far around it."""
    block = [int(at[f"b{k}"][0]) * size[k] for k in "zy"]
    low = [block[0] - n, block[1] - n, int(at["x"].min()) - n]
    shape = [size["z"] + 2 * n, size["y"] + 2 * n, int(at["x"].max()) + n + 1 - low[2]]
    a = np.zeros([s + 2 for s in shape], bool)
    a[tuple(at[k] - l + 1 for k, l in zip("zyx", low))] = True
    for _ in range(n):
        b = a.copy()
        for axis in range(3):
            for here, there in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                cut, other = [slice(None)] * 3, [slice(None)] * 3
                cut[axis], other[axis] = here, there
                b[tuple(cut)] |= a[tuple(other)]
        a = b
    inner = a[1 + n:1 + n + size["z"], 1 + n:1 + n + size["y"], 1:-1]
    z, y, x = np.nonzero(inner)
    z, y, x = z + block[0], y + block[1], x + low[2]
    ok = (z < at["nz"][0]) & (y < at["ny"][0]) & (x >= 0) & (x < at["nx"][0])
    return {k: v[ok] for k, v in zip("zyx", (z, y, x))}


def _sides(a, axis):
    """The cells before and behind along an axis; none beyond the ends."""
    before, behind = np.zeros_like(a), np.zeros_like(a)
    first, rest = [slice(None)] * 3, [slice(None)] * 3
    first[axis], rest[axis] = slice(None, -1), slice(1, None)
    before[tuple(rest)], behind[tuple(first)] = a[tuple(first)], a[tuple(rest)]
    return before, behind


def closed(at, size):
    """Cells of a block in the closing of the mask by the 3x3x3 element; the block comes with the voxels up to two
    places around it. The element is a product of three segments, so both passes run axis by axis."""
    low = [int(at[k].min()) - 1 for k in "zyx"]
    a = np.zeros([int(at[k].max()) - l + 2 for k, l in zip("zyx", low)], bool)
    a[tuple(at[k] - l for k, l in zip("zyx", low))] = True
    for axis in range(3):
        before, behind = _sides(a, axis)
        a = a | before | behind
    for axis, (k, l) in enumerate(zip("zyx", low)):
        place = np.arange(l, l + a.shape[axis])
        a &= ((place >= 0) & (place < at[f"n{k}"][0])).reshape([-1 if i == axis else 1 for i in range(3)])
    for axis in range(3):
        before, behind = _sides(a, axis)
        a = a & before & behind
    found = dict(zip("zyx", (p + l for p, l in zip(np.nonzero(a), low))))
    own = np.ones(len(found["z"]), bool)
    for k, n in size.items():
        own &= found[k] // n == at[f"b{k}"][0]
    return {k: v[own] for k, v in found.items()}


def shell(at):
    """Own voxels of a block with a face neighbour outside the mask; the block comes with its neighbours' edges."""
    own = at["own"]
    low = [int(at[k].min()) - 1 for k in "zyx"]
    a = np.zeros([int(at[k].max()) - l + 2 for k, l in zip("zyx", low)], bool)
    spot = [at[k] - l for k, l in zip("zyx", low)]
    a[tuple(spot)] = True
    z, y, x = (p[own] for p in spot)
    inner = a[z - 1, y, x] & a[z + 1, y, x] & a[z, y - 1, x] & a[z, y + 1, x] & a[z, y, x - 1] & a[z, y, x + 1]
    return {k: at[k][own][~inner] for k in "zyx"}


def label_block(at):
    """6-connected components inside one block; a component is named by its first voxel."""
    order = np.argsort(at["lin"])
    lin, z, y, x = (at[k][order] for k in ("lin", "z", "y", "x"))
    ny, nx = int(at["ny"][0]), int(at["nx"][0])
    a, b = [], []
    for step, c in ((1, x), (nx, y), (ny * nx, z)):
        j = np.minimum(np.searchsorted(lin, lin + step), len(lin) - 1)
        near = (lin[j] == lin + step) & (c[j] == c + 1)
        a.append(np.nonzero(near)[0])
        b.append(j[near])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(lin))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return {"z": z, "y": y, "x": x, "comp": lin[root]}


def second_eigen(a):
    """Square root of the second largest eigenvalue of one co-occurrence transition matrix (g1, g2, p)."""
    levels = np.unique(np.concatenate([a["g1"], a["g2"]]))
    p = np.zeros((len(levels), len(levels)))
    p[np.searchsorted(levels, a["g1"]), np.searchsorted(levels, a["g2"])] = a["p"]
    px, py = p.sum(1), p.sum(0)
    q = (p / px[:, None]) @ (p / py[None, :]).T
    ev = np.sort(np.linalg.eigvals(q).real)[::-1]
    mcc = float(np.sqrt(max(ev[1], 0.0))) if len(ev) > 1 else 1.0
    return {"mcc": np.array([mcc])}


def _mix32(x):
    """A bijective 32-bit finaliser (two multiply-xorshift steps) on unsigned numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def place_noise(key, axis, places):
    """Uniform numbers in [-1, 1) for every (z, y, x) of three lists of places, by hashing one after the other."""
    z, y, x = (np.asarray(p, np.uint32) for p in places)
    h = _mix32(np.array([key ^ axis], np.uint32))
    h = _mix32(h ^ z)
    h = _mix32(h[:, None] ^ y)
    h = _mix32(h[..., None] ^ x)
    return h / 2.0 ** 31 - 1.0


def gaussian(sigma):
    """Weights of a Gaussian cut off at 3 sigma, summing to one."""
    r = max(int(np.ceil(3 * sigma)), 0)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return w / w.sum()


def blurred_noise(key, axis, shape, box, sigma, axes=(0, 1, 2)):
    """Gaussian blur along ``axes`` of the noise of one axis, on a box of the grid; zero beyond the grid."""
    w = gaussian(sigma)
    r = len(w) // 2
    reach = [(max(lo - r, 0), min(hi + r, n)) if k in axes else (lo, hi) for k, ((lo, hi), n) in enumerate(zip(box, shape))]
    f = place_noise(key, axis, [np.arange(lo, hi) for lo, hi in reach])
    for k in axes:
        (lo, hi), (low, high) = box[k], reach[k]
        f = np.moveaxis(f, k, 0)
        f = np.pad(f, [(r - (lo - low), r - (high - hi)), (0, 0), (0, 0)])
        out = np.zeros((hi - lo, *f.shape[1:]))
        for t, weight in enumerate(w):
            out += weight * f[t:t + hi - lo]
        f = np.moveaxis(out, 0, k)
    return f
