"""Stages composed of operators: binning, filling, merging, calibration, regions, routing.

Each stage takes and returns long tables with a ``run_id`` where an ensemble is involved; a caller may
write any of them between stages or leave the whole chain to one job.
"""
