"""Sources of log lines: batch files and a tailing stream."""
