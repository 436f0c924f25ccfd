"""Classic NetCDF files (CDF-1 and CDF-2): dimensions, attributes and variables, read and written as bytes.

The layout is the published classic format: a big-endian header of lists, then
the data of fixed variables and of record variables in turn.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: The format's type codes, and its tags of the three lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


@dataclass
class Variable:
    dims: tuple[str, ...]
    values: np.ndarray
    attrs: dict = field(default_factory=dict)


@dataclass
class Dataset:
    dims: dict[str, int]
    variables: dict[str, Variable]
    attrs: dict = field(default_factory=dict)


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def number(self, kind: str = "i") -> int:
        (out,) = struct.unpack_from(">" + kind, self.raw, self.at)
        self.at += struct.calcsize(kind)
        return out

    def padded(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return out

    def name(self) -> str:
        return self.padded(self.number()).decode("utf-8")

    def items(self, tag: int, one) -> list:
        found, n = self.number(), self.number()
        if n and found != tag:
            raise ValueError("not a classic NetCDF header")
        return [one() for _ in range(n)]

    def attribute(self):
        name, kind, n = self.name(), self.number(), self.number()
        raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
        if kind == 2:
            return name, raw.decode("utf-8", "replace")
        values = np.frombuffer(raw, TYPES[kind], n)
        return name, values[0].item() if n == 1 else values.astype(values.dtype.newbyteorder("="))


def parse(raw: bytes) -> Dataset:
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise ValueError("only classic NetCDF files (CDF-1, CDF-2) are read here")
    r = _Reader(raw)
    r.at = 4
    records = r.number()
    dims = r.items(DIMENSIONS, lambda: (r.name(), r.number()))
    attrs = dict(r.items(ATTRIBUTES, r.attribute))
    offset = "i" if raw[3] == 1 else "q"

    def variable():
        name = r.name()
        ids = [r.number() for _ in range(r.number())]
        return name, ids, dict(r.items(ATTRIBUTES, r.attribute)), r.number(), r.number(), r.number(offset)

    heads = r.items(VARIABLES, variable)
    is_record = lambda ids: bool(ids) and dims[ids[0]][1] == 0
    sizes = {h[0]: int(np.prod([dims[i][1] for i in h[1][is_record(h[1]) :]], dtype=np.int64)) for h in heads}
    each = {h[0]: -(-sizes[h[0]] * np.dtype(TYPES[h[3]]).itemsize // 4) * 4 for h in heads}
    moving = [h for h in heads if is_record(h[1])]
    stride = sum(each[h[0]] for h in moving) if len(moving) != 1 else sizes[moving[0][0]] * np.dtype(TYPES[moving[0][3]]).itemsize
    out = {}
    for name, ids, own, kind, _, begin in heads:
        shape = [dims[i][1] for i in ids]
        if is_record(ids):
            shape[0] = records
            parts = [np.frombuffer(raw, TYPES[kind], sizes[name], begin + k * stride) for k in range(records)]
            values = np.concatenate(parts) if parts else np.empty(0, TYPES[kind])
        else:
            values = np.frombuffer(raw, TYPES[kind], sizes[name], begin)
        values = values.reshape(shape)
        out[name] = Variable(tuple(dims[i][0] for i in ids), values if kind == 2 else values.astype(values.dtype.newbyteorder("=")), own)
    return Dataset({n: k or records for n, k in dims}, out, attrs)


def _name(text: str) -> bytes:
    raw = text.encode("utf-8")
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(attrs: dict) -> bytes:
    if not attrs:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", ATTRIBUTES, len(attrs))
    for k, v in attrs.items():
        if isinstance(v, str):
            raw = v.encode("utf-8")
            out += _name(k) + struct.pack(">ii", 2, len(raw)) + raw + b"\0" * (-len(raw) % 4)
        else:
            values = np.atleast_1d(np.asarray(v))
            values = values.astype(">i4" if values.dtype.kind in "iub" else ">f8")
            raw = values.tobytes()
            out += _name(k) + struct.pack(">ii", CODES[values.dtype.str[1:]], len(values)) + raw + b"\0" * (-len(raw) % 4)
    return out


def build(data: Dataset) -> bytes:
    """The bytes of a CDF-2 file with dimensions of fixed length."""
    names = list(data.dims)
    arrays = {}
    for k, v in data.variables.items():
        a = np.asarray(v.values)
        a = a.astype({"b": "i1", "i": "i4", "u": "i4"}.get(a.dtype.kind, a.dtype.str[1:]) if a.dtype.kind != "i" or a.dtype.itemsize > 4 else a.dtype.str[1:])
        arrays[k] = a.astype(">" + a.dtype.str[1:])
    sizes = {k: -(-a.nbytes // 4) * 4 for k, a in arrays.items()}

    def header(begins: dict[str, int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", 0)
        out += struct.pack(">ii", DIMENSIONS, len(names)) + b"".join(_name(n) + struct.pack(">i", data.dims[n]) for n in names) if names else struct.pack(">ii", 0, 0)
        out += _attributes(data.attrs)
        out += struct.pack(">ii", VARIABLES, len(arrays))
        for k, a in arrays.items():
            v = data.variables[k]
            out += _name(k) + struct.pack(">i", len(v.dims)) + b"".join(struct.pack(">i", names.index(d)) for d in v.dims) + _attributes(v.attrs)
            out += struct.pack(">iiq", CODES[a.dtype.str[1:]], sizes[k], begins[k])
        return out

    at = len(header(dict.fromkeys(arrays, 0)))
    begins = {}
    for k in arrays:
        begins[k], at = at, at + sizes[k]
    return header(begins) + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 4) for a in arrays.values())
