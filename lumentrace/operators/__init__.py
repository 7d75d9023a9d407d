"""DataFrame operators: measurements, stimuli, corrections, signals, regions, tables, overviews."""
