"""DataFrame operators: labelling, cleaning, profiling, splitting, scaling,
evaluation and classifiers."""
