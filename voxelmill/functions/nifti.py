"""NIfTI-1 bytes to arrays: the small per-file helper behind the volume source."""

import gzip
import struct

import numpy as np

# Datatype codes of the public NIfTI-1 header.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def decode(content: bytes):
    """(array in file axis order, spacing, 4x4 affine) of one .nii or .nii.gz file."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", raw[40:56])
    shape = dim[1:1 + dim[0]]
    pix = struct.unpack(order + "8f", raw[76:108])
    code = struct.unpack(order + "h", raw[70:72])[0]
    start, slope, inter = struct.unpack(order + "3f", raw[108:120])
    data = np.frombuffer(raw, order + DTYPES[code], int(np.prod(shape)), int(start))
    data = data.reshape(shape, order="F").astype("f8")
    if slope not in (0.0, 1.0) or (slope and inter):
        data = data * slope + inter
    affine = np.eye(4)
    if struct.unpack(order + "h", raw[254:256])[0] > 0:
        affine[:3] = np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4)
    else:
        affine[[0, 1, 2], [0, 1, 2]] = pix[1:4]
    return data, [float(p) for p in pix[1:4]], affine.ravel().tolist()


def encode(data: np.ndarray, spacing, affine=None, packed=True) -> bytes:
    """Float64 NIfTI-1 bytes of an array (for fixtures), compressed unless ``packed`` is False."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, *[1.0] * (7 - len(spacing)))
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    if affine is not None:
        struct.pack_into("<h", head, 254, 1)
        struct.pack_into("<12f", head, 280, *np.asarray(affine, "f4").ravel()[:12])
    raw = bytes(head) + np.asarray(data, "<f8").tobytes(order="F")
    return gzip.compress(raw, 1) if packed else raw
