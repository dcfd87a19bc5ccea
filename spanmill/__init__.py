"""Analytics over sampled language-model completions, and training-data operators, on Spark."""
