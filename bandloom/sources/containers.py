"""NumPy containers through Spark's binary file source; other containers behind their libraries. Workbooks are in ``workbook``."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import BandloomError, needs, require


def _arrays(content: bytes, path: str) -> dict[str, np.ndarray]:
    if path.endswith(".npy"):
        return {"data": np.load(io.BytesIO(content), allow_pickle=False)}
    if path.endswith(".npz"):
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            return {k: z[k] for k in z.files}
    if path.endswith(".mat"):
        require(not content[:128].startswith(b"MATLAB 7.3"), "MAT_V73", "MAT 7.3 files are HDF5; convert them")
        return {k: v for k, v in needs("scipy.io", "MAT files").loadmat(io.BytesIO(content)).items() if not k.startswith("__")}
    if path.endswith((".h5", ".hdf5", ".nc")):
        found = {}
        with needs("h5py", "HDF5 and NetCDF 4 files").File(io.BytesIO(content), "r") as f:
            f.visititems(lambda name, node: found.update({name: node[()]}) if hasattr(node, "shape") else None)
        return found
    raise BandloomError("CONTAINER_KIND", "not a container that can be read", path=path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per variable of a container: name, type, shape and the role it could have."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"]):
                for name, a in _arrays(bytes(c), p).items():
                    a = np.asarray(a)
                    role = "spectra" if a.ndim == 2 and np.issubdtype(a.dtype, np.number) and min(a.shape) > 1 else "axis or labels" if a.ndim <= 2 and a.size else "other"
                    out.append((name, str(a.dtype), list(map(int, a.shape)), role))
            yield pd.DataFrame(out, columns=["name", "dtype", "shape", "role"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "name string, dtype string, shape array<long>, role string")


def read_matrix(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """(sample_idx, x) of the named variable, or of the only real 2-D one."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                found = _arrays(bytes(c), p)
                if variable is None:
                    fit = [k for k, a in found.items() if np.asarray(a).ndim == 2 and np.issubdtype(np.asarray(a).dtype, np.number)]
                    require(len(fit) == 1, "VARIABLE", "which variable holds the spectra?", variables=sorted(found))
                    a = found[fit[0]]
                else:
                    require(variable in found, "VARIABLE", "no such variable", variables=sorted(found))
                    a = found[variable]
                a = np.asarray(a)
                require(a.ndim == 2, "NOT_2D", "spectra are a 2-D array", shape=list(a.shape))
                require(not np.iscomplexobj(a), "COMPLEX", "spectra must be real")
                for lo in range(0, len(a), 10_000):
                    part = a[lo : lo + 10_000].astype(float)
                    yield pd.DataFrame({"sample_idx": np.arange(lo, lo + len(part)), "x": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "sample_idx long, x array<double>")
