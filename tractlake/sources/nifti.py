"""Affine and dimensions from the header of a NIfTI-1 image."""

from __future__ import annotations

import struct

import numpy as np

from tractlake.errors import FormatError
from tractlake.model import Header


def parse(data: bytes) -> Header:
    """The sform if it is set, else the qform, else voxel sizes on the diagonal."""
    if len(data) < 348:
        raise FormatError("NIfTI header is cut short")
    end = next((e for e in "<>" if struct.unpack_from(f"{e}i", data, 0)[0] == 348), None)
    if end is None:
        raise FormatError("not a NIfTI-1 header")
    dim = struct.unpack_from(f"{end}8h", data, 40)
    pixdim = struct.unpack_from(f"{end}8f", data, 76)
    qform, sform = struct.unpack_from(f"{end}2h", data, 252)
    b, c, d, *shift = struct.unpack_from(f"{end}6f", data, 256)
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack_from(f"{end}12f", data, 280)).reshape(3, 4)
    elif qform > 0:
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine[:3, :3] = turn * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
        affine[:3, 3] = shift
    else:
        affine[:3, :3] = np.diag(pixdim[1:4])
    return Header(affine.tolist(), [int(x) for x in dim[1:4]])
