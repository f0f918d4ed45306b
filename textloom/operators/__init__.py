"""Table operators: windows, learning, calibration, evaluation, scope, sheet."""
