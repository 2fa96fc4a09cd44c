"""Where the small tables lie."""

SF = "/root/testdata/sf0.001"
