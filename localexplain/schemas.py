"""Table layouts.  Vectors are ``ARRAY<DOUBLE>``; one row per instance, sample or fit."""

MODEL = "model_id STRING, w ARRAY<DOUBLE>, bias DOUBLE, d INT, dataset STRING, accuracy DOUBLE"
FEATURES = "feature_idx INT, name STRING"
BACKGROUND = "feature_idx INT, mean DOUBLE"
INSTANCES = "instance_id BIGINT, x0 ARRAY<DOUBLE>"
SAMPLES = "instance_id BIGINT, sample_id INT, x ARRAY<DOUBLE>, z ARRAY<INT>"
SCORES = "instance_id BIGINT, sample_id INT, pred DOUBLE, dist DOUBLE, weight DOUBLE"

# Sums over the samples of one instance.  d = x - x0, y = pred - bb_x0, w = weight; ``g`` is the
# upper triangle of sum(w d d') by rows.
MOMENTS = (
    "instance_id BIGINT, x0 ARRAY<DOUBLE>, bb_x0 DOUBLE, n BIGINT, sw DOUBLE, swy DOUBLE, swyy DOUBLE, "
    "sd ARRAY<DOUBLE>, sdd ARRAY<DOUBLE>, swd ARRAY<DOUBLE>, swdy ARRAY<DOUBLE>, g ARRAY<DOUBLE>"
)

FITS = (
    "instance_id BIGINT, solver STRING, ridge DOUBLE, coeff ARRAY<DOUBLE>, intercept DOUBLE, "
    "surr_x0 DOUBLE, bb_x0 DOUBLE, r2 DOUBLE, num_iters INT, n_samples BIGINT, sum_weights DOUBLE, "
    "x0 ARRAY<DOUBLE>, x_mean ARRAY<DOUBLE>, loss ARRAY<DOUBLE>"
)

TIMINGS = (
    "D INT, B INT, gpu_gen DOUBLE, gpu_infer DOUBLE, gpu_weights DOUBLE, gpu_total DOUBLE, "
    "cpu_gen DOUBLE, cpu_infer DOUBLE, cpu_weights DOUBLE, cpu_total DOUBLE"
)
