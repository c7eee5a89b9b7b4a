"""Turns in the plane and in space, as small values on the driver; :func:`rotate` applies one to a frame."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

RATIO_FWHM_TO_SIGMA = 2 * math.sqrt(2 * math.log(2))


@dataclass(frozen=True)
class Rotation2D:
    """A turn by ``angle`` radians."""

    angle: float = 0.0

    @staticmethod
    def from_angle(angle: float, degrees: bool = False) -> "Rotation2D":
        return Rotation2D(math.radians(angle) if degrees else angle)

    @staticmethod
    def from_matrix(matrix) -> "Rotation2D":
        m = np.asarray(matrix, float)
        if m.shape != (2, 2) or not np.allclose(m @ m.T, np.eye(2)) or np.linalg.det(m) < 0:
            raise ValueError("not the matrix of a turn")
        return Rotation2D(math.atan2(m[1, 0], m[0, 0]))

    @staticmethod
    def align_vectors(vector: Sequence[float], other: Sequence[float] = (1, 0)) -> "Rotation2D":
        """The turn of ``other`` into the direction of ``vector``."""
        return Rotation2D(math.atan2(other[0] * vector[1] - other[1] * vector[0], vector[0] * other[0] + vector[1] * other[1]))

    def as_angle(self, degrees: bool = False) -> float:
        return math.degrees(self.angle) if degrees else self.angle

    def as_matrix(self) -> np.ndarray:
        c, s = math.cos(self.angle), math.sin(self.angle)
        return np.array([[c, -s], [s, c]])

    def apply(self, vectors) -> np.ndarray:
        return np.asarray(vectors, float) @ self.as_matrix().T

    def inv(self) -> "Rotation2D":
        return Rotation2D(-self.angle)

    def __mul__(self, other: "Rotation2D") -> "Rotation2D":
        """First ``other``, then this."""
        return Rotation2D(self.angle + other.angle)


@dataclass(frozen=True)
class Rotation3D:
    """A turn as a unit quaternion (x, y, z, w)."""

    quat: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 1.0)

    @staticmethod
    def from_quat(quat: Sequence[float]) -> "Rotation3D":
        q = np.asarray(quat, float)
        if not np.linalg.norm(q):
            raise ValueError("a quaternion of length 0")
        return Rotation3D(tuple((q / np.linalg.norm(q)).tolist()))

    @staticmethod
    def from_rotvec(vector: Sequence[float], degrees: bool = False) -> "Rotation3D":
        """The axis times the angle."""
        v = np.radians(vector) if degrees else np.asarray(vector, float)
        angle = float(np.linalg.norm(v))
        return Rotation3D.from_quat([*(v / angle * math.sin(angle / 2)), math.cos(angle / 2)] if angle else [0, 0, 0, 1])

    @staticmethod
    def from_euler(axes: str, angles: float | Sequence[float], degrees: bool = False) -> "Rotation3D":
        """Turns about up to three axes: lower case about the fixed axes one after the other, upper case about the moving ones."""
        angles = np.atleast_1d(np.radians(angles) if degrees else np.asarray(angles, float))
        if len(angles) != len(axes) or not (set(axes) <= set("xyz") or set(axes) <= set("XYZ")):
            raise ValueError("one angle per axis, of xyz or XYZ")
        out = Rotation3D()
        for axis, angle in zip(axes, angles):
            step = Rotation3D.from_rotvec(np.eye(3)["xyz".index(axis.lower())] * angle)
            out = out * step if axis.isupper() else step * out
        return out

    @staticmethod
    def from_matrix(matrix) -> "Rotation3D":
        m = np.asarray(matrix, float)
        if m.shape != (3, 3) or not np.allclose(m @ m.T, np.eye(3)) or np.linalg.det(m) < 0:
            raise ValueError("not the matrix of a turn")
        # the quaternion is the eigenvector of the largest eigenvalue of this symmetric matrix
        k = np.zeros((4, 4))
        k[:3, :3] = m + m.T - np.trace(m) * np.eye(3)
        k[3, :3] = k[:3, 3] = [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]
        k[3, 3] = np.trace(m)
        return Rotation3D.from_quat(np.linalg.eigh(k)[1][:, -1])

    def as_quat(self) -> np.ndarray:
        return np.array(self.quat)

    def as_matrix(self) -> np.ndarray:
        *v, w = self.quat
        v = np.array(v)
        cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        return np.eye(3) + 2 * w * cross + 2 * cross @ cross

    def as_rotvec(self, degrees: bool = False) -> np.ndarray:
        q = self.as_quat() * (1 if self.quat[3] >= 0 else -1)
        length = float(np.linalg.norm(q[:3]))
        out = q[:3] / length * 2 * math.atan2(length, q[3]) if length else np.zeros(3)
        return np.degrees(out) if degrees else out

    def magnitude(self) -> float:
        return float(np.linalg.norm(self.as_rotvec()))

    def apply(self, vectors) -> np.ndarray:
        return np.asarray(vectors, float) @ self.as_matrix().T

    def inv(self) -> "Rotation3D":
        x, y, z, w = self.quat
        return Rotation3D((-x, -y, -z, w))

    def __mul__(self, other: "Rotation3D") -> "Rotation3D":
        """First ``other``, then this."""
        a, b = np.array(self.quat), np.array(other.quat)
        v = a[3] * b[:3] + b[3] * a[:3] + np.cross(a[:3], b[:3])
        return Rotation3D.from_quat([*v, a[3] * b[3] - a[:3] @ b[:3]])


def rotate(df: DataFrame, rotation: Rotation2D | Rotation3D) -> DataFrame:
    """The coordinates turned about the origin, as one projection."""
    from ..operators.transforms import transform_affine

    return transform_affine(df, rotation.as_matrix())
