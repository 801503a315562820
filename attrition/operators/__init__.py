"""DataFrame -> DataFrame building blocks.

spine       C1 spine, C2 cohort          facts       per-(student, day) pre-aggregates
accumulate  cumulative features, W1, C9  prefilter   membership filter of the cohort's keys
ranking     exact row numbers/running sums without one task per group
prepare     C10 model frame, M2 split, M3 balancing
dictionary  M4/M5 distributed levels     encode      M4/M5 as a pyspark.ml pipeline
models      M6-M11 fits, certificate, M20 importance
evaluate    A15, M12-M19 metrics, AUC    scoring     fixed rules for SQL-checkable predictions
stats       M1 correlation from co-moments
"""
