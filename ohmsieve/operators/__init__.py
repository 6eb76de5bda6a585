"""Feature families, rules, target encoding, residual calibration and decisions."""
