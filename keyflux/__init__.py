"""Analytics over keyed numeric tables, and the iterative models trained on them, on PySpark."""
