"""Fixed values of the flow data set: names, lists, prefixes and search grids.

Everything here is data that results depend on. Names are spelt as in the file headers;
``functions.names.normalise`` turns them into the identifiers used inside the engine.
"""

# --- fixed values: label text -> attack flag ("DDoS " with a trailing blank is its own key)
LABEL_MAP = {
    "Normal": 0,
    "Probe": 1,
    "DDoS": 1,
    "DoS": 1,
    "BFA": 1,
    "Web-Attack": 1,
    "BOTNET": 1,
    "U2R": 1,
    "DDoS ": 1,
}

# --- fixed values: the flow identifier and twelve columns that never vary
DROP_CONSTANT = [
    "Flow ID", "Fwd PSH Flags", "Fwd URG Flags", "CWE Flag Count", "ECE Flag Cnt",
    "Fwd Byts/b Avg", "Fwd Pkts/b Avg", "Fwd Blk Rate Avg", "Bwd Byts/b Avg",
    "Bwd Pkts/b Avg", "Bwd Blk Rate Avg", "Init Fwd Win Byts", "Fwd Seg Size Min",
]

# --- fixed values: raw columns replaced by derived ones
DROP_RAW = ["Src IP", "Dst IP", "Timestamp"]

# --- fixed values: subnet flag name -> address prefix
DST_PREFIXES = {
    "Dst 192.168.8": "192.168.8.",
    "Dst 192.168.3.": "192.168.3.",
    "Dst 200.175.2.": "200.175.2.",
    "Dst 192.168.20.": "192.168.20.",
    "Dst 172.17.0.": "172.17.0.",
}
SRC_PREFIXES = {
    "Src 192.168.3.": "192.168.3.",
    "Src 200.175.2.": "200.175.2.",
    "Src 192.168.20.": "192.168.20.",
    "Src 172.17.0.": "172.17.0.",
}

# --- fixed values: measurement groups; the first four feed the outlier detectors
GROUP_1 = [
    "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Pkt Len Mean", "Fwd Pkt Len Std",
    "Bwd Pkt Len Max", "Bwd Pkt Len Min",
]
GROUP_2 = [
    "Bwd Pkt Len Mean", "Bwd Pkt Len Std", "Flow Byts/s", "Flow Pkts/s", "Flow IAT Mean",
    "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Tot", "Fwd IAT Mean",
    "Fwd IAT Std",
]
GROUP_3 = [
    "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Tot", "Bwd IAT Mean", "Bwd IAT Std",
    "Bwd IAT Max", "Bwd IAT Min", "Bwd PSH Flags", "Bwd URG Flags", "Fwd Header Len",
    "Bwd Header Len",
]
GROUP_4 = [
    "Fwd Pkts/s", "Bwd Pkts/s", "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean",
    "Pkt Len Std", "Pkt Len Var", "FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt",
    "PSH Flag Cnt",
]
GROUP_5 = [
    "ACK Flag Cnt", "URG Flag Cnt", "Down/Up Ratio", "Pkt Size Avg", "Fwd Seg Size Avg",
    "Bwd Seg Size Avg", "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts",
    "Subflow Bwd Byts", "Init Bwd Win Byts",
]
GROUP_6 = [
    "Fwd Act Data Pkts", "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# --- fixed values: columns recorded as redundant by correlation
DROP_CORRELATED = [
    "Bwd IAT Tot", "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Byts",
    "Bwd Header Len", "Subflow Bwd Pkts", "Fwd Pkt Len Std", "Fwd Seg Size Avg",
    "Bwd Pkt Len Max", "Bwd Seg Size Avg", "Flow Pkts/s", "Flow IAT Std", "Flow IAT Max",
    "Bwd IAT Max", "Idle Mean", "Idle Max", "Idle Min", "Bwd PSH Flags", "URG Flag Cnt",
    "Pkt Len Mean", "Pkt Len Std",
]
CORRELATION_THRESHOLD = 0.95

# --- fixed values: columns recorded as eliminated by recursive selection
DROP_ELIMINATED = [
    "Src Port", "Protocol", "Flow Duration", "Tot Fwd Pkts", "Fwd Pkt Len Mean",
    "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Flow Byts/s", "Flow IAT Mean", "Fwd IAT Tot",
    "Fwd IAT Std", "Fwd IAT Max", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Min",
    "Bwd URG Flags", "Fwd Header Len", "Fwd Pkts/s", "Pkt Len Min", "Pkt Len Var",
    "FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt",
    "Pkt Size Avg", "Active Mean", "Active Std", "Active Max", "Weekend",
    "Dst 192.168.8", "Dst 172.17.0.", "Src 172.17.0.",
]

# --- fixed values: the features that survive
FINAL_FEATURES = [
    "Dst Port", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Fwd Pkt Len Max",
    "Fwd Pkt Len Min", "Bwd Pkt Len Std", "Flow IAT Min", "Fwd IAT Mean", "Fwd IAT Min",
    "Bwd Pkts/s", "Pkt Len Max", "Down/Up Ratio", "Init Bwd Win Byts",
    "Fwd Act Data Pkts", "Active Min", "Idle Std", "hr_sin_minutes", "hr_cos_minutes",
    "hr_sin_hours", "hr_cos_hours", "Dst 192.168.3.", "Dst 200.175.2.",
    "Dst 192.168.20.", "Src 192.168.3.", "Src 200.175.2.", "Src 192.168.20.",
]

# --- fixed values: isolation forest
FOREST_TREES = 50
FOREST_SAMPLE = 256
FOREST_FEATURES = 8
FOREST_SEED = 1
CONTAMINATION = 0.0001

# --- fixed values: row ids recorded as outliers, per measurement group
RECORDED_OUTLIERS = {
    "group_1": [
        137634, 138049, 147620, 147664, 147667, 147864, 148224, 148677, 148919, 161840,
        161850, 162344, 162484, 162553, 163620, 165565, 170556, 171865, 172068, 172073,
        172372, 172887, 173297, 174005, 174117, 174122, 174772, 174882, 183635, 184528,
        185984, 195031, 202947, 202972,
    ],
    "group_2": [
        138429, 138540, 138768, 140200, 140343, 140449, 142446, 148192, 148802, 149547,
        154315, 155973, 156111, 157924, 162540, 168084, 169795, 170457, 170502, 172539,
        174147, 174305, 178548, 186159, 186622, 192352, 199391, 204259, 275986, 276453,
        278726, 279174, 281082,
    ],
    "group_3": [
        148217, 149500, 149601, 152625, 153470, 153924, 154777, 154869, 154989, 155226,
        155270, 155595, 155913, 173338, 183233,
    ],
    "group_4": [
        142919, 149492, 162537, 167153, 167785, 167854, 168314, 168498, 168674, 168866,
        169467, 169601, 169697, 169907, 170153, 172172, 173961, 183184, 187781, 195726,
        195774, 197408, 201427, 204487, 204554,
    ],
}

# --- fixed values: folds and seeds
FOLDS = 5
SELECTION_SEED = 3
CV_SEED = 1

# --- fixed values: hyper-parameter grids
GRID_LOGISTIC_C = [20, 30, 40, 50]
GRID_FOREST_TREES = [100, 200, 300]
GRID_PERCEPTRON_HIDDEN = [(50, 50, 50), (50, 50), (100,)]

# --- fixed values: accepted time texts, day first; (shape, datetime pattern)
TIME_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$", "d/M/yyyy h:mm:ss a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/yyyy H:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
]

OUTLIER_GROUPS = {"group_1": GROUP_1, "group_2": GROUP_2, "group_3": GROUP_3, "group_4": GROUP_4}
MEASUREMENTS = GROUP_1 + GROUP_2 + GROUP_3 + GROUP_4 + GROUP_5 + GROUP_6
