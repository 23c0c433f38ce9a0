import numpy as np
import pytest

from trackloom import fixtures as X
from trackloom.functions import geometry as G
from trackloom.operators import calibration, pose, views
from trackloom.operators.reconstruction import PAIRS, camera_list

RIG = camera_list(X.camera_rows())
RNG = np.random.default_rng(0)
POINTS = np.stack((RNG.uniform(-0.8, 0.8, 200), RNG.uniform(-0.8, 0.8, 200), RNG.uniform(0, 1.8, 200)), axis=1)


def test_fisheye_round_trip():
    for camera in RIG:
        rays = POINTS @ camera.r.T + camera.t
        assert np.allclose(camera.undistort(camera.project(POINTS)), rays[:, :2] / rays[:, 2:], atol=1e-10)


def test_pinhole_round_trip():
    camera = G.Camera(0, "pinhole", 1280, 960, RIG[0].k, np.array([-0.1, 0.01, 0.001, -0.002, 0.0, 0.01, 0, 0]), RIG[0].r, RIG[0].t)
    xy = RNG.uniform(-0.5, 0.5, (100, 2))
    assert np.allclose(camera.undistort(camera.to_pixels(np.concatenate((xy, np.ones((100, 1))), axis=1))), xy, atol=1e-9)


def test_triangulation_is_exact_without_noise():
    uv = np.stack([c.project(POINTS) for c in RIG])
    points, error = G.triangulate(RIG, uv, np.ones(uv.shape[:2]))
    assert np.abs(points - POINTS).max() < 1e-9 and np.nanmax(error) < 1e-6


def test_an_outlier_view_is_left_out():
    uv = np.stack([c.project(POINTS[:50]) for c in RIG]) + RNG.normal(0, 0.5, (3, 50, 2))
    uv[2, :10] += 80
    points, error = G.triangulate(RIG, uv, np.ones((3, 50)))
    assert np.linalg.norm(points - POINTS[:50], axis=1).max() < 0.03
    assert np.isnan(error[2, :10]).sum() >= 9 and np.isfinite(error[:, 10:]).all()


def test_two_views_do_one_does_not():
    uv = np.stack([c.project(POINTS[:3]) for c in RIG])
    uv[0, 0] = np.nan
    uv[:2, 1] = np.nan
    points, _ = G.triangulate(RIG, uv, np.ones((3, 3)))
    assert np.allclose(points[[0, 2]], POINTS[[0, 2]]) and np.isnan(points[1]).all()


def test_swapped_arms_are_undone():
    body = np.array(X.BODY)
    places = body[None] + np.stack((np.linspace(-0.4, 0.4, 60), np.linspace(0.3, -0.3, 60), np.zeros(60)), axis=1)[:, None]
    clean = np.stack([c.project(places.reshape(-1, 3)).reshape(60, 23, 2) for c in RIG])
    uv = clean.copy()
    left, right = PAIRS[0]
    uv[1][20:40][:, left + right] = clean[1][20:40][:, right + left]
    fixed, _, swaps = G.swap_repair(RIG, uv, np.ones(uv.shape[:3]), PAIRS, 0.5, 15.0, 0.6, 5.0)
    assert swaps[20:40, 0, 1].sum() >= 18 and swaps[:20].sum() + swaps[40:].sum() == 0
    assert np.abs(fixed[1, swaps[:, 0, 1]] - clean[1, swaps[:, 0, 1]]).max() < 1e-6


def test_butterworth_gain_and_steady_state():
    b, a = G.butterworth(4, 0.4)
    w = np.linspace(0.01, 3, 50)
    z = np.exp(-1j * w)
    gain = np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) ** 2
    assert np.allclose(gain, 1 / (1 + (np.tan(w / 2) / np.tan(np.pi * 0.4 / 2)) ** 8))
    assert np.allclose(G.zero_phase(b, a, np.full((40, 3), 2.5)), 2.5)


def test_hull_of_a_rectangle():
    points = np.concatenate((RNG.uniform(0, 1, (200, 2)) * [10, 4], [[0, 0], [10, 0], [10, 4], [0, 4]]))
    corners = G.hull(points)
    assert len(corners) == 4
    assert G.inside_hull(corners, np.array([[5.0, 2.0], [0, 0], [10, 2], [10.1, 2], [-1, -1]])).tolist() == [True, True, True, False, False]


def test_a_folding_lens_is_noticed():
    assert calibration.monotonic_radius("fisheye", 420.0, X.DISTORTION, 700.0) == float("inf")
    assert calibration.monotonic_radius("fisheye", 600.0, (-0.16, -0.81, 8.98, -24.78), 900.0) < 900


def test_joint_names_are_matched():
    names = list(reversed(pose.JOINTS))
    assert [names[i] for i in pose.joint_map(names)] == pose.JOINTS
    with pytest.raises(KeyError):
        pose.joint_map(names[1:])


def test_virtual_views_hold_the_box():
    boxes = np.array([[560.0, 380, 700, 700], [40, 300, 200, 760], [1000, 100, 1200, 500]])
    r, f, box = views.make_views(RIG[0], boxes)
    p = np.einsum("nij,nkj->nki", r, RIG[0].rays(views.perimeter(boxes)))
    crop = p[..., :2] / p[..., 2:] * f[:, None, None] + np.array([383.5, 511.5])
    assert np.allclose(np.concatenate((crop.min(axis=1), crop.max(axis=1)), axis=1), box) and np.allclose((box[:, :2] + box[:, 2:]) / 2, [383.5, 511.5], atol=8)
    straight = views.make_views(RIG[0], boxes, up=RIG[0].r.T @ RIG[0].rays(np.array([[630.0, 540.0]]))[0])
    assert np.isfinite(straight[0]).all() and np.allclose(straight[0] @ straight[0].transpose(0, 2, 1), np.eye(3))
    assert (crop > 0).all() and (crop[..., 0] < 768).all() and (crop[..., 1] < 1024).all()
