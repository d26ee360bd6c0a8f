"""Query plans over the shared test tables, and the end-to-end workflows."""
