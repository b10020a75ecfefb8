"""A catalog over the test tables, and the queries over it that the driver compares with SQL."""
